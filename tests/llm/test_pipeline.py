"""The pipeline's stages follow one another as brute force would.

Toxicity, a learned model, is compared with the operator's own scores, which have tests of
their own; all other stages with plain loops over their own input.
"""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evalweave.llm import toxicity


def _near_kept(texts):
    """The smallest doc_id of each component of five-word shingle sets with a similarity of 0.8 or more."""
    sets, label = {}, {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        label[i] = i

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {i for i in label if find(i) == i}


def _cut(texts):
    """Texts without the words of windows that begin in a document with a smaller id."""
    first, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        out[i] = texts[i] if all(keep) else b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()
    return out


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "near", "substring", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        assert set(after) <= set(before)
        if name == "exact":
            seen = {}
            for i, r in before.items():
                key = "".join((r.text or "").split())
                seen.setdefault(hashlib.sha256(key.encode()).digest(), []).append((-len(r.text or ""), i))
            assert set(after) == {min(g)[1] for g in seen.values()}
        if name == "toxicity":
            scores = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r.doc_id for r in scores.collect() if not r.predicted}
        if name == "near":
            assert set(after) == _near_kept({i: r.text for i, r in before.items()})
        if name == "substring":
            assert {i: r.text for i, r in after.items()} == _cut({i: r.text for i, r in before.items()})
        else:
            assert all(r == before[i] for i, r in after.items())
        before = after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(before)
    for p in pieces:
        ids = np.array([*tokenizer.encode(before[p.doc_id].text, add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
    assert docs.count() == 0
