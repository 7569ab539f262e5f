"""The registered queries of the training-data operators."""

from __future__ import annotations

from tessera.llm import chat, codes, langid, middles, mixing, neighbours, packing, scoring, shards, simhash, sketches, suffixes, toxicity

QUERIES = {
    "op1_scoring": scoring.query,
    "op2_toxicity": toxicity.query,
    "op3_mixing": mixing.query,
    "op4_sketches": sketches.query,
    "op5_langid": langid.query,
    "op6_neighbours": neighbours.query,
    "op7_chat": chat.query,
    "op8_packing": packing.query,
    "op9_simhash": simhash.query,
    "op10_suffixes": suffixes.query,
    "op11_codes": codes.query,
    "op12_shards": shards.query,
    "op13_middles": middles.query,
}
ORACLES: dict[str, str] = {"op11_codes": codes.SQL, "op13_middles": middles.SQL}
