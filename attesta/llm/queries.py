"""Queries of the training-data operators and their SQL, where SQL can say the same."""

from __future__ import annotations

from . import ann, langid, licenses, mixing, neardup, packing, pii, sharding, topk, urlfilter


def queries() -> dict:
    found = [ann.op1_collision_counting, langid.op2_mixture_langid, neardup.op3_order_minhash, urlfilter.op4_path_templates, topk.op5_norm_buckets, sharding.op6_virtual_slots, packing.op7_length_buckets, licenses.op8_license_scan, mixing.op9_mix, pii.op10_disclosure]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op4_path_templates": urlfilter.OP4_SQL, "op5_norm_buckets": topk.OP5_SQL, "op9_mix": mixing.OP9_SQL}
