"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import re

import corpus_pipeline
from groundtrack.llm.common import cut
from tests.llm.test_text_operators import brute_components, brute_lines


def plain(t):
    """Words of letters and digits, A-Z lowered."""
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(text, item, least=13, share=0.8):
    a, b = plain(text), plain(item)
    w = min(least, len(b))
    return any(sum(a[i + k] == b[j + k] for k in range(w)) >= share * w for i in range(len(a) - w + 1) for j in range(len(b) - w + 1))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 70")
    columns = docs.columns
    benchmark = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name != "source_mix":
            assert docs.columns == columns
        ids = sorted(before)
        if name == "language_id":
            lettered = {d for d, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
            assert set(after) <= lettered and len(after) >= 0.98 * len(lettered)
        if name == "line_dedup":
            gone = brute_lines([before[d].text for d in ids])
            for k, d in enumerate(ids):
                left = [x for i, x in enumerate(before[d].text.split("\n")) if i not in gone.get(k, [])]
                assert after[d].text == "\n".join(left)
        if name == "jaccard_join":
            parts = brute_components([before[d].text for d in ids], 5, 80, 100)
            assert set(after) == {ids[i] for i, _, c, _ in parts if i == c}
        if name == "decontaminate":
            held = {d for d in ids if any(leaks(before[d].text, b) for b in benchmark)}
            assert set(after).isdisjoint({d for d in ids if any(b in (before[d].text or "") for b in benchmark)})
            assert set(before) - set(after) == held
        if name == "source_mix":
            assert all(0 < r.mix_taken <= 2 * r.mix_size for r in rows)
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.values())
            assert abs(sum(r.mix_taken for r in rows) - 1.5 * total) <= 20
        before = after
