"""The queries of the corpus operators, by name."""

from __future__ import annotations

from playerday.llm.fingerprints import op1_fingerprints
from playerday.llm.mixing import OP4_SQL, op4_mix_sources
from playerday.llm.neighbours import op5_neighbours
from playerday.llm.packing import op10_best_fit_packing
from playerday.llm.pii import op9_pii
from playerday.llm.quality import op8_quality
from playerday.llm.repair import op13_conversation_repair
from playerday.llm.secrets import op2_secret_scan
from playerday.llm.simhash import op7_simhash_near_dedup
from playerday.llm.spelling import op12_spelling_variants
from playerday.llm.suffixes import op11_suffix_dedup
from playerday.llm.toxicity import op6_toxicity
from playerday.llm.warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_secret_scan, op3_warc, op4_mix_sources, op5_neighbours, op6_toxicity, op7_simhash_near_dedup, op8_quality, op9_pii, op10_best_fit_packing, op11_suffix_dedup, op12_spelling_variants, op13_conversation_repair)}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op4_mix_sources": OP4_SQL}
