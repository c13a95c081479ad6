"""The operators' queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import op2_url_lists as urls
from .op1_neighbours import op1_neighbours
from .op2_url_lists import op2_url_lists
from .op3_lines import op3_lines
from .op4_decontaminate import op4_decontaminate
from .op5_minhash import op5_minhash
from .op6_language import op6_language_id
from .op7_tokens import op7_token_output
from .op8_mixing import op8_mixing
from .op9_repeats import op9_repeats
from .op10_counts import op10_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_neighbours, op2_url_lists, op3_lines, op4_decontaminate, op5_minhash, op6_language_id, op7_token_output, op8_mixing, op9_repeats, op10_token_counts)
}
ORACLE_SQL: dict[str, str] = {"op2_url_lists": urls.ORACLE}
