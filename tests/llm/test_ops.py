import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import byte_bpe, chat, exact_dedup, language, licenses, mixing, near_dedup, registry, repeats, token_count, vector_dedup
from gridloom.llm.common import Scratch, numbered

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, _text double"


def docs(spark, tmp_path, rows, name="docs"):
    """A Parquet table with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "r", "k", 0.5) for i, t, lang, s in rows], DOCS)
    df.coalesce(2).write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def phrase(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", None), (None, "No id here", "en", "a"), (5, "Same TEXT", "en", "a"), (6, "sAME text", "fr", "b"), (6, "sAME text", "fr", "b"), (7, "word " * 30_000, "en", "a"), (8, "123 456 !!", None, "b"), (9, "é" * 5_000, "fr", "c")]


@pytest.fixture()
def odd(spark, tmp_path):
    return docs(spark, tmp_path, ODD)


@pytest.fixture()
def empty(spark, tmp_path):
    return docs(spark, tmp_path, [], "empty")


def test_mix(spark, odd, empty, tmp_path):
    assert mixing.mix_decisions(empty).count() == 0 and mixing.mix(empty).count() == 0
    got = mixing.mix_decisions(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got)
    many = docs(spark, tmp_path, [(k, "w " * (k % 7 + 1), "en", "hot" if k % 3 else f"s{k % 5}") for k in range(3000)], "many")
    rows = mixing.mix_decisions(many).collect()
    taken, target = {}, {}
    for r in rows:
        source = "hot" if r.doc_id % 3 else f"s{r.doc_id % 5}"
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = (r.target, r.source_size)
    assert all(abs(taken[s] - t) <= 7 and t <= 3 * size for s, (t, size) in target.items())
    assert sum(t for t, _ in target.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_decisions(many).collect()))
    mixed = mixing.mix(many)
    assert mixed.columns == many.columns and mixed.count() == sum(r.copies for r in rows)


def test_exact(odd, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    got = exact_dedup.exact_duplicates(odd).collect()
    same = [r for r in got if r.doc_id in (5, 6)]
    assert all(r.keep_id == 6 and r.group_size == 3 for r in same) and sum(r.kept for r in same) == 1
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {2}
    assert next(r for r in got if r.doc_id == 5).text_sha256 == hashlib.sha256(b"same text").hexdigest()
    least = exact_dedup.exact_duplicates(odd, keep="min").collect()
    assert {r.keep_id for r in least if r.doc_id in (5, 6)} == {5}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_runs_of_many_partitions(spark, monkeypatch, keep):
    """Several rounds, chunks merged few at a time, a hot digest, null ids, ties, equal digests of different lengths; then one merge in this process with several chunks a range."""
    for name, value in {"FAN": 3, "RANGES": 4, "CHUNK": 5, "AT_ONCE": 3}.items():
        monkeypatch.setattr(exact_dedup, name, value)  # workers have the ranges and chunks of the module
    rng = random.Random(3)
    rows = []
    for rid in range(4000):
        k = 0 if rng.random() < 0.3 else rng.randrange(1500)
        digest = bytes(32) if k == 0 else hashlib.sha256(str(k).encode()).digest()[: 32 - k % 3] + bytes(k % 3)
        rows.append((digest, k % 2 if k > 9 else 7 - rid % 2, None if rng.random() < 0.2 else rng.randrange(50), rid))
    base = spark.createDataFrame(rows, "digest binary, n_bytes long, id long, rid long").repartition(20)
    want = {}
    for digest, n_bytes, i, rid in rows:
        sign = -1 if keep == "max" else 1
        want.setdefault((digest, n_bytes), []).append((i is None, 0 if i is None else sign * i, rid, i))
    got = {(bytes(r.digest), r.n_bytes): (r.keep_id, r.keep_rid, r.group_size) for r in exact_dedup.merge_runs(base, keep).collect()}
    want = {k: (min(v)[3], min(v)[2], len(v)) for k, v in want.items()}
    assert got == want
    chunks = []
    for node in range(5):
        run = sorted(rows[node::5], key=lambda r: r[:2])
        batch = pa.RecordBatch.from_arrays([pa.array([node] * len(run), pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*run, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], ["node", "digest", "n_bytes", "id", "rid"])
        chunks += [r for b in exact_dedup._first_runs(keep)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
    assert max(len(c["rows"]) for c in chunks) == 5 * exact_dedup.ENTRY.itemsize and len({c["part"] for c in chunks}) == 4
    chunks = pa.Table.from_pylist([c | {"node": 0} for c in sorted(chunks, key=lambda c: c["first"])], pa.schema([("node", pa.int32()), ("part", pa.int32()), ("first", pa.binary()), ("rows", pa.binary())]))
    merged = list(exact_dedup._merge(keep)(chunks.to_batches(max_chunksize=11)))
    assert [r["first"] for b in merged for r in b.to_pylist()] == sorted(r["first"] for b in merged for r in b.to_pylist())
    out = [r for b in exact_dedup._unpack(iter(merged)) for r in b.to_pylist()]
    assert len(out) == len(want) and {(r["digest"], r["n_bytes"]): (r["keep_id"], r["keep_rid"], r["group_size"]) for r in out} == want


def test_token_counts(odd, empty):
    model = P.path("piece_bpe_32k.model")
    sp = token_count._processor(model)
    assert token_count.token_counts(empty, model).count() == 0
    got = sorted((r.n_bytes, r.n_tokens) for r in token_count.token_counts(odd, model).collect())
    assert got == sorted((len((t or "").encode()), len(sp.encode(t or ""))) for _, t, _, _ in ODD)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the", " ", "  ", "▁", "\n", "a", "é", "<s>", "日", "\t", "ing"]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    assert token_count.count_tokens(sp, token_count.whole_words(model), texts) == [len(sp.encode(t)) for t in texts]


def test_bpe(odd, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = byte_bpe.Encoder(path, P.PATTERN, byte_bpe.irregular_tokens(path))
    rng = random.Random(4)
    for _ in range(600):
        t = "".join(rng.choice(["a", "the", " ", "  ", "-", "é", "12", "x", "ion", "日本", "aaaa", "'s"]) for _ in range(rng.randint(0, 90)))
        assert list(np.frombuffer(ours.encode(t), "<u4")) == enc.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()
    assert ours.joins > 1000
    rare = [t for t in byte_bpe.irregular_tokens(path)]
    assert all(list(np.frombuffer(ours.encode(t), "<u4")) == enc.encode_ordinary(t) for t in ["x" * 5000, "qz" * 3000, *(r.decode("utf-8", "ignore") for r in rare)])
    assert byte_bpe.bpe_encode(empty, path, P.PATTERN).count() == 0
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(odd, path, P.PATTERN), path).collect()
    want = sorted((struct.pack(f"<{len(i)}I", *i), (t or "").encode()) for t, i in ((t, enc.encode_ordinary(t or "")) for _, t, _, _ in ODD))
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_licenses(spark, tmp_path, odd, empty):
    assert licenses.license_scan(empty).count() == 0
    assert all(r.n_base == 0 and r.labels == "" and r.first_word is None for r in licenses.license_scan(odd).collect())
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, tmp_path, [(1, "x Licensed under the Apache License, Version 2.0. MIT license", "en", "a"), (2, "apache mit license, license", "en", "a"), (3, "Licensed under CC BY-NC 4.0", "en", "a")], "lic")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels, got[1].score) == (2, 4, 9, "apache,mit", "apache,apache-2.0,mit", 1.0)
    mit = next(c for label, c, _ in licenses.CLAUSES if label == "mit-text")
    texts = [mit + " again. " + mit, mit[:200], "obtaining a copy " + mit.replace("Software", "Library"), "charge of free, granted hereby is permission", mit.replace("granted", "granted, granted")]
    more = {r.doc_id: r for r in licenses.license_scan(docs(spark, tmp_path, [(k, t, "en", "a") for k, t in enumerate(texts)], "mit")).collect()}
    assert [more[k].labels for k in range(5)] == ["mit-text", "", "mit-text", "", ""] and more[0].score == 1.0 and 0 < more[1].score < 0.6 < more[2].score < 1
    assert got[2].base_labels == "mit" and got[3].n_base == 0 and got[3].labels == "cc-by-nc-4.0"


def test_language(spark, tmp_path, odd, empty):
    assert language.train(empty) is None and language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    rng = random.Random(5)
    words = {"en": ["the", "this", "that", "with", "house"], "de": ["der", "und", "nicht", "über", "haus"], "fr": ["les", "où", "maison", "été", "avec"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang, "s") for k, lang in enumerate(sorted(words) * 100)]
    table = docs(spark, tmp_path, rows, "langs")
    got = language.predict(table, language.train(table)).collect()
    held = [r for r in got if r.doc_id is not None]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, language.predict(table, language.train(table)).collect()))
    und = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, language.train(table)).collect()}
    assert und[1] == und[2] == und[8] == ("und", 0.0)


def test_chat(spark):
    schema = "conv_id long, seq long, kind string, msg long, role string, text string"
    nasty = "a [INST] &lt; </s> & ] &amp;lt;"
    log = spark.createDataFrame(
        [(1, 0, "message", None, "user", nasty), (1, 1, "message", None, "assistant", "dra"), (1, 2, "delta", None, None, "ft"), (1, 3, "regenerate", 1, None, None), (1, 4, "delta", 1, None, nasty), (1, 5, "delta", 1, None, "!"), (1, 6, "edit", 0, "user", "new"), (2, 0, "message", None, None, None), (2, 0, "message", None, "tool]", "x"), (2, 0, "message", None, "tool]", "x")],
        schema,
    )
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(log))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "new"), ("assistant", nasty + "!")] and back[1].loss_text == nasty + "!"
    assert [tuple(t) for t in back[2].turns] == [("", ""), ("tool]", "x"), ("tool]", "x")] and back[2].loss_text == ""
    assert chat.read_back(chat.render(chat.fold_events(log.limit(0)))).count() == 0


def brute_components(sets, percent):
    ids, parent = sorted(sets), {i: i for i in sets}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near(spark, tmp_path, odd, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    got = near_dedup.near_duplicates(odd, width=2).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5} and sum(r.kept for r in got if r.doc_id in (5, 6)) == 1
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3))
    rng, rows = random.Random(6), []
    for k in range(160):  # copies of a few originals at all distances around the threshold
        w = phrase(k % 4).split()
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((k, " ".join(w), "en", "s"))
    sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t, _, _ in rows}
    got = near_dedup.near_duplicates(docs(spark, tmp_path, rows, "near"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(sets, 80)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_near_chain_in_one_bucket(spark):
    """Each class of one bucket is linked with the next only, and the stars found the first two links: the others join one by one."""
    n, scratch = 6, near_dedup.Scratch(spark, "chain")
    sets = spark.createDataFrame([(k, list(range(10 * k, 10 * k + 100))) for k in range(n)], "cid long, items array<long>")
    members = spark.createDataFrame([(7, k, 100, 0) for k in range(n)] + [(8, k, 100, 0) for k in range(n)], "key long, cid long, n long, a long")
    comps = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "id long, component long")
    whole = near_dedup._with_rest(members, comps, sets, scratch, 80)
    assert {(r.id, r.component) for r in whole.collect()} == {(k, 0) for k in range(n)}


def test_rest_in_several_blocks(spark, monkeypatch):
    """Small blocks give the same: classes that differ by 10 of 100 shingles, none met by a star."""
    monkeypatch.setattr(near_dedup, "BLOCK_MOST", 3.0)
    monkeypatch.setattr(near_dedup, "BLOCK_LEAST", 2)
    n, scratch = 13, near_dedup.Scratch(spark, "blocks")
    start = [200 * (k % 3) + 10 * (k // 3) for k in range(n)]
    sets = spark.createDataFrame([(k, list(range(s, s + 100))) for k, s in enumerate(start)], "cid long, items array<long>")
    members = spark.createDataFrame([(key, k, 100, 0) for key in (7, 8) for k in range(n) if key == 7 or k != 5], "key long, cid long, n long, a long")
    whole = near_dedup._with_rest(members, spark.createDataFrame([], "id long, component long"), sets, scratch, 80)
    assert {(r.id, r.component) for r in whole.collect()} == {(k, k % 3) for k in range(n)}


def test_numbers_stay(spark, tmp_path):
    """Rows keep their numbers, and the operators their results, when tables are split otherwise from job to job."""
    rows = [(k, f"{phrase(k // 3, 45)} {phrase(1000 + k, 3)}" if k % 2 else phrase(k // 4, 90), "en", "s") for k in range(300)]
    table = spark.createDataFrame([(i, t, lang, s, len(t), "r", "k", 0.5) for i, t, lang, s in rows], DOCS)
    table.repartition(3).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/split")
    docs_ = spark.read.parquet(f"{tmp_path}/split")
    scratch = near_dedup.Scratch(spark, "numbers")
    seen, conf = [], "spark.sql.leafNodeDefaultParallelism"
    for filtered in (docs_, docs_.where("doc_id >= 0").select("doc_id", "text"), docs_.limit(300), docs_.unionByName(docs_)):
        whole = numbered(filtered, scratch, "row_")
        for cores in ("1", "16"):
            spark.conf.set(conf, cores)
            got = {r.row_: r.doc_id for r in whole.collect()}
            seen.append(got)
            assert len(got) == filtered.count()
        assert seen[-1] == seen[-2]
        spark.conf.unset(conf)
    real, results = Scratch.write, []

    def write(self, df, name):  # another split in each job
        write.n += 1
        self.spark.conf.set(conf, str(1 + write.n % 7))
        return real(self, df, name)

    for cls in (real, write):
        write.n, Scratch.write = 0, cls
        try:
            near = sorted(map(str, near_dedup.near_duplicates(docs_, width=2).collect()))
            cut = sorted(map(str, repeats.remove_repeats(docs_).collect()))
            stages = [sorted(r.doc_id for r in stage(spark, docs_, "").collect()) for name, stage in corpus_pipeline.STAGES[:3]]
        finally:
            Scratch.write = real
            spark.conf.unset(conf)
        results.append((near, cut, stages))
    assert results[0] == results[1]


def test_sketch_estimates():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = np.unique(x[:1000]), np.unique(x[200:])
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.registers(np.unique(x)) == np.maximum(ra, rb)).all()  # mergeable
    est = near_dedup.estimate(ra[None], rb[None], np.array([1000]), np.array([1000]))[0]
    assert abs(est - 800 / 1200) < 0.12


def test_repeats(spark, tmp_path, odd, empty):
    assert repeats.remove_repeats(empty).count() == 0
    rng = random.Random(8)
    passages = [phrase(k, 45) for k in range(3)] + ["ab" * 150, "z" * 450]
    rows = list(ODD) + [(100 + k, " ".join(rng.choice([phrase(1000 + k * 7 + m, 20), rng.choice(passages)[rng.randint(0, 60) :]]) for m in range(6)), "en", "s") for k in range(40)]
    got = repeats.remove_repeats(docs(spark, tmp_path, rows, "rep")).collect()
    want = repeats.brute_force([(t or "").encode() for _, t, _, _ in rows])
    ours = sorted((r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert ours == sorted(want)


def test_repeats_of_hot_anchors(spark, tmp_path, monkeypatch):
    """Anchors with more regions than a block takes give the same."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "BLOCK", 5)
    rng = random.Random(18)
    passage = phrase(3, 60)
    rows = [(k, phrase(100 + k, rng.randint(0, 20)) + passage[rng.randint(0, 100) : rng.randint(150, 360)] + phrase(500 + k, rng.randint(0, 20)), "en", "s") for k in range(60)] + [(k, "ab" * rng.randint(90, 400), "en", "s") for k in range(60, 64)]
    got = repeats.remove_repeats(docs(spark, tmp_path, rows, "hot")).collect()
    want = repeats.brute_force([t.encode() for _, t, _, _ in rows])
    assert sorted((r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == sorted(want)


def test_runs_are_one_row():
    raw = b"z" * 100_000
    at, h = repeats.anchors(raw)
    order, starts, n = repeats._runs(h.view(np.int64), np.zeros(len(at), np.int64), at, repeats.LENGTH)
    assert len(at) > 90_000 and len(starts) == 1 and n[0] == len(at)


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:5]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (204, [1.0, 2.0]), (205, []), (206, [float("inf")] * 16), (None, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = vector_dedup.near_vectors(table)
    r = {v.vec_id: v for v in got.collect()}
    assert len(r) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    assert sum(r[k].n_links for k in range(len(x))) >= 0.9 * (near.sum() - len(x))
    assert all(r[k].n_links <= near[k].sum() - 1 for k in range(len(x)))
    assert r[80].component_id == 0 and not r[80].kept
    assert all(r[k].n_links == 0 and r[k].kept and r[k].component_id == k for k in range(200, 207)) and r[None].kept
    assert vector_dedup.recall(got, vector_dedup.audit(table.where("vec_id < 200"), every=1)) >= 0.9
    assert vector_dedup.near_vectors(table.limit(0)).count() == 0


def test_vectors_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.01]), (3, [1.0, 0.0, 0.01])]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False)]


def test_vectors_in_many_clusters_and_parts(spark, monkeypatch):
    """Two levels of centres, clusters in several parts: no wrong link, recall of 0.9 and more, the right components."""
    for name, value in {"CLUSTER": 40, "CENTRES": 5, "SHARD_LIMIT": 90, "SAMPLE": 400, "FIRST": 16, "AUDIT_QUERIES": 300, "AUDIT_ROWS": 700}.items():
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(19)
    base = rng.normal(size=(300, 24))
    x = np.concatenate([base, base[:200] + 0.1 * rng.normal(size=(200, 24)), base[0] + 0.08 * rng.normal(size=(600, 24))])
    assert len(vector_dedup.fit_levels(vector_dedup._unit(list(x)), len(x))) > 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = vector_dedup.near_vectors(table)
    r = {v.vec_id: v for v in got.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    audited = vector_dedup.audit(table, every=1)
    assert {a.vec_id: a.exact_links for a in audited.collect()} == dict(enumerate(near.sum(1).tolist()))
    assert all(r[k].n_links <= near[k].sum() for k in r) and vector_dedup.recall(got, audited) >= 0.9
    sets = brute_components({k: {k} for k in r}, 101)
    find = lambda i: i if sets[i] == i else find(sets[i])
    for a, b in np.argwhere(near):
        p, q = find(int(a)), find(int(b))
        sets[max(p, q)] = min(p, q)
    assert np.mean([r[k].component_id == find(k) for k in r]) > 0.98


def test_pipeline(spark, tmp_path):
    rng, rows = random.Random(10), []
    words = {"en": ["the", "this", "that", "with", "house"], "de": ["der", "und", "nicht", "über", "haus"]}
    for k in range(120):
        lang = sorted(words)[k % 2]
        rows.append((k, " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(40)), lang, f"s{k % 3}"))
    rows += [(500 + k, rows[k][1].encode().upper().decode(), rows[k][2], "s0") for k in range(10)] + [(600 + k, rows[k + 20][1] + " end", rows[k + 20][2], "s1") for k in range(5)] + [(700, None, None, None), (701, "123", "en", "s0"), (None, "the house this that", "en", "s2")]
    folder = tmp_path / "sf"
    folder.mkdir()
    docs(spark, folder, rows, "documents.parquet")
    kept, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = kept.columns
        stage(spark, kept, str(folder)).write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        seen.append([r.doc_id for r in kept.collect()])
        assert name == "byte_bpe" or kept.columns == columns
    assert set(seen[0]) == {r[0] for r in rows} - {700, 701}
    assert set(seen[1]) == set(seen[0]) - set(range(10))
    assert set(seen[2]) == set(seen[1]) - set(range(600, 605))
    decisions = {r.doc_id: r.copies for r in mixing.mix_decisions(spark.read.parquet(f"{folder}/near_dedup")).collect()}
    assert sorted(map(str, seen[3])) == sorted(str(i) for i, c in decisions.items() for _ in range(c)) and sorted(map(str, seen[4])) == sorted(map(str, seen[3]))
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()))) == sorted(map(str, seen[4]))


def test_long_texts_by_windows(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["", "aB ç", "".join(map(chr, rng.integers(60, 900, 1200))), "xyz " * 50]
    weights = rng.normal(size=(language.BUCKETS, 3)).astype(np.float32)

    def both():
        return language.Model(list("abc"), weights, np.zeros(3), 1.0).logits(texts), list(language.counted(texts))

    logits, counts = both()
    monkeypatch.setattr(language, "CHUNK", 100)
    again, counts_again = both()
    assert np.allclose(logits, again, atol=1e-9)
    for (a, n), (b, m) in zip(counts, counts_again, strict=True):
        assert (a == b).all() and (n == m).all()


def test_round_trip_is_encode_then_decode(odd):
    path = P.path("byte_bpe_50k.tiktoken")
    one = byte_bpe.bpe_round_trip(odd, path, P.PATTERN)
    two = byte_bpe.bpe_decode(byte_bpe.bpe_encode(odd, path, P.PATTERN), path)
    assert one.schema == two.schema
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_language_by_a_plain_version(spark, tmp_path, monkeypatch):
    """The same model and predictions by dictionaries and loops; held-out rows change nothing, and a language with one document is learnt."""
    monkeypatch.setattr(language, "EPOCHS", 1)
    rng = random.Random(21)
    words = {"en": ["the", "this", "that"], "de": ["der", "und", "über"], "xx": ["qqq"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(6)), lang, "s") for k, lang in enumerate(["en", "de"] * 15)]
    free = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows.append((free, "qqq qqq", "xx", "s"))
    table = docs(spark, tmp_path, rows, "plain")
    model = language.train(table)
    assert model.langs == ["de", "en", "xx"]

    def grams(text):
        codes, out = [ord(c) for c in text.lower()] + [32, 32, 32], {}
        for at in range(len(text.lower())):
            h = 0
            for n in range(3):
                h = (h + codes[at + n] + n + 1) * 0x9E3779B1 % 2**32
                h ^= h >> 15
                b = h * 0x85EBCA6B % 2**32 >> 16
                out[b] = out.get(b, 0) + 1
        return out

    learnt = [(i, grams(t), lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = {}
    for _, g, _ in learnt:
        for b in g:
            df[b] = df.get(b, 0) + 1
    idf = {b: math.log((1 + len(learnt)) / (1 + n)) + 0.05 for b, n in df.items()}
    order = {r.id: r.h for r in table.select(F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).alias("h")).collect()}
    examples = [({b: 64.0 * n / sum(g.values()) * idf[b] for b, n in sorted(g.items())} | {"bias": 1.0}, model.langs.index(lang)) for i, g, lang in sorted(learnt, key=lambda e: order[e[0]])]
    z, n = {}, {}
    weight = lambda b, c: -math.copysign(max(abs(z.get((b, c), 0.0)) - (0.05 if b != "bias" else 0.0), 0.0), z.get((b, c), 0.0)) / ((1 + math.sqrt(n.get((b, c), 0.0))) / 0.3 + 0.01)
    for x, y in examples:
        w = {(b, c): weight(b, c) for b in x for c in range(3)}
        logits = [sum(v * w[b, c] for b, v in x.items()) for c in range(3)]
        e = [math.exp(v - max(logits)) for v in logits]
        for c in range(3):
            for b, v in x.items():
                g = v * (e[c] / sum(e) - (c == y))
                s = (math.sqrt(n.get((b, c), 0.0) + g * g) - math.sqrt(n.get((b, c), 0.0))) / 0.3
                z[b, c] = z.get((b, c), 0.0) + g - s * w[b, c]
                n[b, c] = n.get((b, c), 0.0) + g * g
    got = {r.doc_id: r for r in language.predict(table, model).collect()}
    for i, t, _, _ in rows:
        g = grams(t)
        logits = [weight("bias", c) + sum(64.0 * m / sum(g.values()) * idf[b] * weight(b, c) for b, m in g.items() if b in idf) for c in range(3)]
        e = [math.exp((v - max(logits)) / model.temperature) for v in logits]
        best = max(range(3), key=lambda c: e[c])
        assert got[i].lang_pred == model.langs[best] and got[i].score == pytest.approx(e[best] / sum(e), abs=1e-4)
    changed = docs(spark, tmp_path, [(i, "zzz", "yy", s) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, lang, s) for i, t, lang, s in rows], "changed")
    other = language.train(changed)
    assert other.langs == model.langs and (other.weights == model.weights).all() and other.temperature == model.temperature


def test_queries_columns(spark, tmp_path):
    """Every query's contract on odd rows: columns, their types, a row a row, and values by plain code."""
    folder = tmp_path / "sf"
    folder.mkdir()
    rows = [r for r in ODD if r[0] is not None] + [(20 + k, phrase(k % 3, 60) + f" mit license {k}", "en", "s") for k in range(6)]
    docs(spark, folder, rows, "documents.parquet")
    said = [(1, 0, "user", "a [INST] &lt; b"), (1, 1, "assistant", None), (2, 0, "system", "s"), (2, 1, "assistant", "é" * 3), (2, 2, "tool]", "x"), (3, 0, None, "nobody")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(k, [math.cos(k / 100), math.sin(k / 100)]) for k in range(0, 60, 10)] + [(1, None), (50, [0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(folder))
    types = {"op1_mix": "doc_id bigint size bigint source_size bigint target double taken bigint", "op2_exact_dedup": "doc_id bigint keep_id bigint group_size bigint kept boolean text_sha256 string", "op3_token_counts": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean", "op4_license_scan": "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint base_labels string labels string score double", "op5_near_dedup": "doc_id bigint n_shingles bigint component_id bigint kept boolean", "op6_remove_repeats": "doc_id bigint n_bytes bigint n_removed bigint n_spans bigint kept_sha256 string", "op7_language_id": "doc_id bigint held_out boolean lang_pred string score double", "op8_chat_format": "conv_id bigint n_turns bigint turns_sha256 string loss_chars bigint loss_sha256 string formatted_chars bigint", "op9_vector_dedup": "vec_id bigint n_links bigint component_id bigint kept boolean", "op10_byte_bpe": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string"}
    assert set(types) == set(registry.QUERIES)
    got = {}
    for name, text in types.items():
        result, words = run(name), text.split()
        have = dict(result.dtypes)
        assert {c: have.get(c) for c in words[::2]} == dict(zip(words[::2], words[1::2], strict=True)), name
        got[name] = result.collect()
        assert len(got[name]) == {"op8_chat_format": 4, "op9_vector_dedup": len(vectors)}.get(name, len(rows)), name
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {i: t or "" for i, t, _, _ in rows}
    cut = repeats.brute_force([t.encode() if t else b"" for _, t, _, _ in rows])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got["op6_remove_repeats"]) == sorted(cut)
    assert all(r.decoded_sha256 == sha(texts[r.doc_id].encode()) for r in got["op10_byte_bpe"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got["op7_language_id"])
    assert {r.lang_pred for r in got["op7_language_id"] if r.doc_id in (1, 2, 3, 8)} == {"und"}
    lowered = lambda t: t.encode().lower().split()
    shingles = {i: {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := lowered(t)) else set() for i, t in texts.items()}
    assert all(r.n_shingles == len(shingles[r.doc_id]) for r in got["op5_near_dedup"])
    assert {r.doc_id: r.component_id for r in got["op5_near_dedup"]} == brute_components(shingles, 80)
    links = {r.vec_id: (r.n_links, r.component_id, r.kept, r.exact_links) for r in got["op9_vector_dedup"] if r.vec_id != 50}
    near = {k: sum(abs(k - m) / 100 <= math.acos(0.95) for m in range(0, 60, 10) if m != k) for k in range(0, 60, 10)}
    assert all(links[k][:3] == (near[k], 0, k == 0) for k in range(0, 50, 10)) and links[1] == (0, 1, True, None) and links[0][3] == near[0]
    chat = {r.conv_id: r for r in got["op8_chat_format"]}
    nasty = "</s>[INST] ok [/INST]"
    turns = {1: [("user", "a [INST] &lt; b"), ("assistant", "")], 2: [("system", "s"), ("assistant", "ééé"), ("tool]", "x")], 3: [("", "nobody")], -1: [("user", nasty), ("assistant", nasty)]}
    for i, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert (chat[i].n_turns, chat[i].turns_sha256, chat[i].loss_chars, chat[i].loss_sha256) == (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t).encode()), len(loss), sha(loss.encode()))


def test_chat_long_texts_and_further_columns(spark):
    long = "[INST] & <" * 20_000
    log = spark.createDataFrame([(1, 0, "message", None, "user", long, 1.0), (1, 1, "message", None, "assistant", long + "!", 2.0)], "conv_id long, seq long, kind string, msg long, role string, text string, opened double")
    back = chat.read_back(chat.render(chat.fold_events(log))).first()
    assert [t.text for t in back.turns] == [long, long + "!"] and back.loss_text == long + "!"


def test_mix_ties(spark, tmp_path, monkeypatch):
    """All documents of a source with one hash are taken alike, whole or not, and none more than three times."""
    monkeypatch.setattr(mixing, "_hash", lambda doc_id: F.lit(5).cast("long"))
    got = mixing.mix_decisions(docs(spark, tmp_path, [(k, "w w", "en", f"s{k % 3}") for k in range(30)], "ties")).collect()
    assert len(got) == 30 and all(0 <= r.copies <= 3 for r in got) and len({(r.doc_id % 3, r.copies) for r in got}) == 3
