"""Merkle fingerprints: neighbours, equality, likeness, located edits."""

import hashlib

from fleetlog.llm import merkle
from tests.llm.helpers import LONG, ROWS, docs, ordered


def _expect(rows):
    own = ordered([(r[0], r[1] or "") for r in rows])
    out = []
    for k, (i, t) in enumerate(own):
        new = merkle.edited_text(t, own[(k + 1) % len(own)][1])
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.fingerprint(t.encode()),
                    merkle.fingerprint(new.encode()), merkle.likeness(merkle.fingerprint(t.encode()), merkle.fingerprint(new.encode())),
                    merkle.likeness(merkle.fingerprint(t.encode()), merkle.fingerprint(own[(k + 1) % len(own)][1].encode()))))
    return sorted(out, key=str)


def test_edge_documents(spark, tmp_path):
    # of two texts of one id the smaller comes first
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op9_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _expect(ROWS)


def test_neighbours_across_ranges(spark, sf_small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = merkle.op9_fingerprints(spark, sf_small)
    assert got.rdd.getNumPartitions() > 1
    assert sorted((tuple(r) for r in got.collect()), key=str) == _expect(rows)


def test_one_document_and_none(spark):
    one = merkle.fingerprints(docs(spark, ROWS[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert merkle.fingerprints(docs(spark, [])).count() == 0
    assert merkle.fingerprints(docs(spark, [(None, "a", "en", "s", 1)] * 3)).count() == 3


def test_equal_roots_are_equal_texts():
    texts = {r[1] or "" for r in ROWS} | {"a\nb", "a\n\nb", "ab", "a\n", "\na", LONG + "x"}
    prints = {merkle.fingerprint(t.encode()) for t in texts}
    assert len({p[:32] for p in prints}) == len(texts)
    assert all(merkle.likeness(p, p) == 1.0 for p in prints)
    assert all(merkle.likeness(p, q) < 1 for p in prints for q in prints if p != q)


def test_differences_locate_the_edit():
    lines = [f"paragraph number {i} says something of its own" for i in range(60)]
    before = merkle.fingerprint("\n".join(lines).encode())
    lines[37] = "quite another paragraph"
    after = merkle.fingerprint("\n".join(lines).encode())
    found = merkle.differences(after, before)
    assert len(found) == 1
    section, at = found[0]
    sizes = [len(s.split(",")) for s in after[33:].split(";")]
    assert sum(sizes[:section]) + at == 37
    assert merkle.differences(before, before) == []
    assert 0.9 < merkle.likeness(before, after) < 1


def test_likeness_follows_the_share():
    a, b = LONG[:8000] + "The end.", "Quite different words in here, " * 300
    near = merkle.likeness(merkle.fingerprint(a.encode()), merkle.fingerprint(merkle.edited_text(a, b).encode()))
    assert 0.6 < near < 0.9
    assert merkle.likeness(merkle.fingerprint(a.encode()), merkle.fingerprint(b.encode())) < 0.05
