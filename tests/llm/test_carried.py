"""Extra columns keep their values, whatever they are called."""

import pytest
from riskledger.llm import lines, near, quality, sharding, simhash
from tests_llm_rows import CLASHING

STEPS = {
    "near": near.keep_first,
    "simhash": simhash.keep_first,
    "quality": quality.keep_good,
    "lines": lambda d: lines.remove_lines(d, counts=False),
    "all lines": lambda d: lines.remove_lines(d, counts=False, whole=True),
    "slots": lambda d: sharding.number_slots(sharding.assign_shards(d.drop("shard", "slot"), ["doc_id"], 3), ["doc_id"], ["doc_id", "text"]),
}


@pytest.mark.parametrize("name", STEPS)
def test_values_of_extra_columns(edge_docs, name):
    own = {(r.doc_id, r.lang, r.n_chars) for r in edge_docs.collect()}
    out = STEPS[name](edge_docs)
    rows = out.collect()
    assert rows and all((r.doc_id, r.lang, r.n_chars) in own for r in rows)
    assert all(r[c] == "extra" for r in rows for c in CLASHING if c not in ("shard", "slot"))
