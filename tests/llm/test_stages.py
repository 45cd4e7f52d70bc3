"""The pipeline's stages against plain computations, with nulls, ties, repeated rows, clashing names and empty tables."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_verdicts import SCHEMA, docs, rows  # noqa: F401
from tidemark.llm import language_id, rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def as_set(df):
    return Counter(tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect())


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark, docs, rows, tmp_path):
    wide = docs.withColumns({c: F.lit(7) for c in ("row", "size", "text_hash", "copies", "w", "component", "shard")})
    kept = corpus_pipeline.quality_rules(spark, wide, "")
    judged = Counter((r["doc_id"], r["text"]) for r in rules.judge(docs, keep=("text",)).where("kept").collect())
    assert Counter((k[0], k[1]) for k in as_set(kept).elements()) == judged
    spoken = corpus_pipeline.language(spark, wide, "")
    found = language_id.identify(docs, keep=tuple(corpus_pipeline.COLUMNS)).collect()
    want = Counter(tuple(f[c] for c in corpus_pipeline.COLUMNS) for f in found if f["lang_pred"] != "und" and not (f["lang"] is not None and f["lang"] != f["lang_pred"] and f["score"] >= corpus_pipeline.MIN_SCORE))
    assert as_set(spoken) == want
    single = as_set(corpus_pipeline.near_duplicates(spark, wide, ""))
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i] if sets[i] else (r[0], r[1]), []).append(r)
    assert sum(single.values()) == len(groups)
    for group in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert sum(single[r] for r in set(group)) == 1 and any(single[r] and (r[0] is None, r[0] or 0) == least for r in set(group))
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    mixed = as_set(corpus_pipeline.mix_sources(spark, plain, ""))
    assert set(mixed) <= set(as_set(plain)) and all(n <= 2 for n in mixed.values()) and all(r[1] for r in mixed)
    encoded = corpus_pipeline.encode(spark, wide, "")
    assert encoded.count() == len(rows)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert stage(spark, docs.where("false"), "").collect() == []


def test_run_equals_its_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
    key = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select(*key).collect()) == Counter(tuple(r) for r in now.select(*key).collect())
