"""Each operator on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns; results are held against brute force, an exact round trip or the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import bpe, jaccard_join, language_id, lm_score, mixing, rules, sharding, token_counts, vector_graph, warc_zip
from tidemark.llm.queries import PIECE_MODEL, WORD_BPE, tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, node long, copies int"


def words_of(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choice(["th", "er", "an", "in", "on", "ti", "é", "ß"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 300))) for _ in range(60)]
    for k in range(20):  # near copies
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 30 + [None, "", " \n\t ", "one", "two words", "x" * 50_000, "ab cd " * 20_000, "<|endoftext|> </s> ▁ \x1c\x85 İ 1½", "A b\nA b\n\nA b"]
    return [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s1", "s2", "hot", "hot", "hot"][i % 7], len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s0", 1, 1, 2, 3, 4)] * 2


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(docs, empty, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert all(f["size"] >= 0 and 0 <= f["copies"] <= 2 for f in found)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    taken, largest = Counter(), Counter()
    for f in found:
        assert f["source_size"] == sizes[f["source"]] and math.isclose(f["target"], target[f["source"]], rel_tol=1e-9)
        taken[f["source"]] += f["copies"] * f["size"]
        largest[f["source"]] = max(largest[f["source"]], f["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).collect() == []


def test_shard(docs, empty, rows):
    found = sharding.shard(docs, depth=2).collect()
    assert len(found) == len(rows) and {f["shard"] for f in found} <= {0, 1, 2, 3}
    for s in range(4):
        slots = sorted(f["slot"] for f in found if f["shard"] == s)
        assert slots == list(range(len(slots)))
    text = {r[0]: r[1] or "" for r in rows}
    assert all(f["size"] == len(text[f["doc_id"]].encode()) + 1 and f["text_crc32"] == zlib.crc32(text[f["doc_id"]].encode()) for f in found)
    assert sharding.shard(empty).collect() == []


def test_rules(docs, empty, rows):
    found = {f["doc_id"]: f for f in rules.judge(docs).collect()}
    assert rules.judge(docs).count() == len(rows) and rules.judge(empty).collect() == []
    for r in rows:
        t, f = r[1] or "", found[r[0]]
        w = words_of(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == want, r[0]
        assert f["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (f["base_failed"] and f["kept"])


def test_distance(spark):
    d = rules.distance(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(3)))
    e = rules.distance(F.array(F.lit(2), F.lit(4)), F.array(F.lit(1), F.lit(2)))
    assert spark.range(1).select(d, e).first()[:] == (1.0, 0.0)


def test_token_counts(docs, empty, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    found = token_counts.count_tokens(docs, tokenizer_path(PIECE_MODEL)).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(found) == len(rows)
    for f in found:
        n = len(model.encode(text[f["doc_id"]]))
        assert (f["n_tokens"], f["n_bytes"], f["over_limit"]) == (n, len(text[f["doc_id"]].encode()), n > 4096), f["doc_id"]
    assert token_counts.count_tokens(empty, tokenizer_path(PIECE_MODEL)).collect() == []


def test_bpe(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    found = bpe.encode_texts(docs, tokenizer_path(WORD_BPE), values=True).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(found) == len(rows)
    for f in found:
        ids = library.encode(text[f["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert f["ids"] == ids and f["decoded"] == decoded and f["n_tokens"] == len(ids)
        assert f["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and f["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_texts(empty, tokenizer_path(WORD_BPE)).collect() == []


def test_bpe_words_match_exact_merging():
    coder = bpe.SpeculativeBPE(tokenizer_path(WORD_BPE))
    r = random.Random(6)
    words = ["".join(r.choice("aabcdeghilnorstt") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    assert coder.encode_words(words) == coder._exact(words) and 0 < coder.merged < len(words)


def test_jaccard(docs, empty, rows):
    sets = {}
    for r in rows:
        w = words_of(lower(r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and component[b] > component[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    component[b], changed = component[a], True
                elif sets[a] and sets[b] and component[a] > component[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    component[a], changed = component[b], True
    found = jaccard_join.join(docs).collect()
    assert len(found) == len(rows)
    assert {f["doc_id"]: (f["n_shingles"], f["component_id"]) for f in found} == {i: (len(s), component[i]) for i, s in sets.items()}
    assert jaccard_join.join(empty).collect() == []


def test_jaccard_blocks_and_hot_shingles(docs, rows, monkeypatch):
    plain = {f["doc_id"]: f["component_id"] for f in jaccard_join.join(docs).collect()}
    for name, value in (("BLOCK", 3), ("HOT", 2), ("PAIRS_UP_TO", 2), ("KNOWN_SHINGLES", 10)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert {f["doc_id"]: f["component_id"] for f in jaccard_join.join(docs).collect()} == plain


def test_language(spark, empty):
    r = random.Random(2)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(60))
    data = [(i, make("abcdef" if i % 2 else "uvwxyz"), "aa" if i % 2 else "zz", None, 0, 0, 0, 0, 0) for i in range(60)]
    data += [(100, None, "aa", None, 0, 0, 0, 0, 0), (101, "123 !", "aa", None, 0, 0, 0, 0, 0), (102, make("abcdef") * 200, None, None, 0, 0, 0, 0, 0)]
    found = {f["doc_id"]: f for f in language_id.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(found[i]["lang_pred"] == ("aa" if i % 2 else "zz") for i in range(60))
    assert found[100]["lang_pred"] == found[101]["lang_pred"] == "und" and found[102]["lang_pred"] == "aa"
    assert all(f["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= f["score"] <= 1 for i, f in found.items())
    assert language_id.identify(empty).collect() == []


def test_lm_score(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(lm_score, "EPOCHS", 1)
    monkeypatch.setattr(lm_score, "KNOWN_WORDS", 50)  # most words take the join
    words = {r[0]: [*words_of(lower(r[1] or "")), "\n"] for r in rows}
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(words[r[0]])
    n, v = sum(counts.values()), len(counts)
    found = lm_score.score(docs, tokenizer_path(PIECE_MODEL)).collect()
    assert len(found) == len(rows)
    for f in found:
        w = words[f["doc_id"]]
        assert math.isclose(f["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert (f["n_tokens"], f["n_known"], f["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n) and f["score"] < 0
    assert lm_score.score(empty, tokenizer_path(PIECE_MODEL)).collect() == []


def test_lm_probabilities_add_up_to_one():
    model = lm_score.AttentionModel((np.arange(5), np.array([0, 1, 0, 1, 0]), np.arange(5) + 3), 9)
    rng = np.random.default_rng(0)
    stream = np.concatenate([np.append(rng.integers(0, 5, 70), model.end), np.append(rng.integers(0, 5, 3), model.end)])
    at = np.array([0, 71, 75])
    model.fit(stream, at)
    inputs, targets, text = model.windows(stream, at)
    assert (targets >= 0).sum() == len(stream) and text.tolist() == [0, 0, 1]
    total = sum(np.where(targets >= 0, np.exp(model.log_probabilities(inputs, np.where(targets >= 0, s, -1))[0]), 0) for s in range(model.symbols))
    assert np.allclose(total[targets >= 0], 1, atol=1e-4)


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "SLICE_RECORDS", 3)
    big = "é" * 700
    data = [(i, f"http://x/{i}?a=b c\r\nd", big if i in (2, 5, 9) else "small" if i % 2 else f"<p>{i}</p>\r\n\r\n" * 200, 1) for i in range(20)] + [(20, None, None, 1), (21, "u", "", 1)]
    found = warc_zip.archive_and_read(spark.createDataFrame(data, "page_id long, url string, html string, size int").repartition(2), payloads=True).collect()
    assert len(found) == len(data)
    by = {f["page_id"]: f for f in found}
    for i, _, html, _ in data:
        raw = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (by[i]["record_type"], by[i]["refers_to"]) == (("revisit", 9) if i in (2, 5) else ("response", None))
        assert by[i]["payload"] == (b"" if i in (2, 5) else raw)
    none = warc_zip.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.collect() == []


def test_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # so that a ZIP64 end record is written
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", "hello")
        z.writestr("y", "world")
    fs, root = warc_zip.file_system(str(tmp_path))
    reader = warc_zip.ArchiveReader(fs, f"{root}/a.zip")
    at, size = reader.member("y")
    assert reader._at(at, size) == b"world"


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    data = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * 0.05
        data.append((i, v.tolist(), i % 2, 9))
    data += [(400, data[3][1], 1, 9), (401, None, 1, 9), (402, [0.0] * 16, 1, 9), (403, [float("nan")] * 16, 1, 9), (404, data[3][1], None, 9), (405, [None] * 16, 1, 9), (406, [1.0, 2.0], 1, 9), (407, [], 1, 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, node int")
    good = [d for d in data if d[1] and d[2] is not None and None not in d[1] and np.isfinite(d[1]).all() and any(d[1])]
    links = Counter()
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                links[a[0]] += x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    out, _ = vector_graph.near_duplicates(df)
    found = {f["vec_id"]: f for f in out.collect()}
    assert len(found) == len(data) and all(f["n_links"] <= links[i] for i, f in found.items())
    assert sum(f["n_links"] for f in found.values()) >= 0.9 * sum(links.values())
    assert vector_graph.audit(df.where("vec_id <> 406"), out) >= 0.9
    assert all(f["kept"] == (f["component_id"] == i) for i, f in found.items()) and found[401]["n_links"] == found[404]["n_links"] == 0
    assert vector_graph.near_duplicates(spark.createDataFrame([], df.schema))[0].collect() == []


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in rows}
    assert found and all(len(words_of(text[f["doc_id"]])) >= 50 for f in found)
