"""The operators' queries, by name, and the SQL that they equal where SQL can express them."""

from .exact import OP5_SQL, op5_exact_dedup
from .langid import op4_language
from .media import op10_media
from .mixing import OP2_SQL, op2_mixing
from .packing import op9_packing
from .pii import op6_pii
from .secret_scan import op1_secrets
from .sharding import op7_sharding
from .simhash import op3_simhash
from .urls import OP8_SQL, REDIRECTS_SQL, op8_url_filter, redirect_aliases

QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_simhash, op4_language, op5_exact_dedup, op6_pii, op7_sharding, op8_url_filter, op9_packing, op10_media, redirect_aliases)}
ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op8_url_filter": OP8_SQL, "redirect_aliases": REDIRECTS_SQL}
