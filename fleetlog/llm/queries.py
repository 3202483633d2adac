"""Registered queries of the operators."""

from __future__ import annotations

from fleetlog.llm.alignment import op13_alignment
from fleetlog.llm.decontaminate import op7_decontamination
from fleetlog.llm.html_text import op8_html
from fleetlog.llm.language import op2_language
from fleetlog.llm.merkle import op9_fingerprints
from fleetlog.llm.packing import op3_packing
from fleetlog.llm.rans import op1_token_ids
from fleetlog.llm.secret_scan import op6_secrets
from fleetlog.llm.shallot import op11_clusters
from fleetlog.llm.sharding import op5_sharding
from fleetlog.llm.sigtree import op12_jaccard
from fleetlog.llm.simhash import op4_simhash
from fleetlog.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_html": op8_html,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_clusters": op11_clusters,
    "op12_jaccard": op12_jaccard,
    "op13_alignment": op13_alignment,
}
