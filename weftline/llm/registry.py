"""Queries of this subpackage, and the SQL for those that SQL expresses."""

from weftline.llm import licenses, quality
from weftline.llm.licenses import op3_licenses
from weftline.llm.mixing import op2_mix
from weftline.llm.neighbours import op6_neighbours
from weftline.llm.pieces import op4_pieces
from weftline.llm.ppm import op9_ppm
from weftline.llm.quality import op1_quality
from weftline.llm.records import op10_token_records
from weftline.llm.secrets import op8_secrets
from weftline.llm.simhash import op5_simhash
from weftline.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_quality, op2_mix, op3_licenses, op4_pieces, op5_simhash, op6_neighbours, op7_toxicity, op8_secrets, op9_ppm, op10_token_records)}
SQL: dict[str, str] = {"op1_quality": quality.SQL, "op3_licenses": licenses.SQL}
