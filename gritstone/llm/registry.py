"""Queries of this subpackage and their DuckDB SQL."""

from . import chat, media, mixing, negatives, neighbours, pieces, quantize, secrets, sharding, simhash, tokens, toxicity, vectors

QUERIES = {
    "op1_media": media.op1_media,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_chat": chat.op4_chat,
    "op5_secrets": secrets.op5_secrets,
    "op6_tokens": tokens.op6_tokens,
    "op7_pieces": pieces.op7_pieces,
    "op8_vectors": vectors.op8_vectors,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_quantize": quantize.op11_quantize,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_negatives": negatives.op13_negatives,
}

ORACLES = {
    "op2_mixing": mixing.OP2_SQL,
    "op4_chat": chat.OP4_SQL,
    "op11_quantize": quantize.OP11_SQL,
    "op12_neighbours": neighbours.OP12_SQL,
    "op13_negatives": negatives.OP13_SQL,
}
