"""Operators against plain versions of what they return."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from siltbed.llm import decontaminate, language, merkle, packing, pii, quality, secrets, shared, simhash, substring_dedup, tokens, words
from siltbed.llm.components import components, forest
from siltbed.llm.queries import QUERIES
from siltbed.sources.folders import new_folder

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture
def ends():
    """Turns an endless loop into a failure."""
    import signal

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


# SimHash


def plain_fingerprint(text):
    w = SPACED.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_equals_all_pairs(spark, cases, case_rows):
    prints = [(r[0], plain_fingerprint(r[1])) for r in case_rows]
    distinct = sorted({f for _, f in prints})
    linked = plain_components([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3], distinct)
    least = {}
    for doc, f in prints:
        if doc is not None:
            least[linked[f]] = min(doc, least.get(linked[f], doc))
    want = Counter((doc, f"{f:016x}", least.get(linked[f])) for doc, f in prints)
    got = Counter(map(tuple, QUERIES["op5_simhash"](spark, cases).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == want


def test_links_cover_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list(centres)
    for c in centres.tolist():
        for _ in range(12):
            f = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                f ^= 1 << b
            fps.append(f)
    fps = sorted({int(x) for x in fps} | {0, 1, 3, 7, 2**64 - 1})
    want = plain_components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3], fps)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for hot in (simhash.HOT, 3):
        edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), hot=hot).collect()
        got = plain_components([(e.a % 2**64, e.b % 2**64) for e in edges], fps)
        assert got == want


def test_hot_anchors_are_split(spark):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**32, 5_000, dtype=np.uint64)).view(np.int64)  # all share one half
    fps = np.unique(np.concatenate([fps, fps[:500] ^ (1 << 40), fps[500:1000] ^ 0b1101]))
    near = [(int(x), int(y)) for k, x in enumerate(fps) for y in fps[k + 1 :][np.bitwise_count((fps[k + 1 :] ^ x).view(np.uint64)) <= 3]]
    got = [(e.a, e.b) for e in simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()]
    assert len(near) > 1000 and plain_components(got, fps.tolist()) == plain_components(near, fps.tolist())


def test_groups_meet_their_aggregates_whatever_their_size(spark, monkeypatch):
    import siltbed.llm.components as module

    rows = [(0, i) for i in range(400)] + [(i, i) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "u long, v long")
    for most in (10_000, 1):
        monkeypatch.setattr(module, "_MOST_HUBS", most)
        got = Counter(map(tuple, module.with_group(df, "u", F.max("v").alias("top")).select("u", "v", "top").collect()))
        assert got == Counter((u, v, 399 if u == 0 else v) for u, v in rows)


def test_each_half_meets_its_neighbours_at_an_anchor():
    rng = np.random.default_rng(3)
    half = rng.integers(0, 2**32, 500, dtype=np.uint64).astype(np.uint32)
    near = half ^ (np.uint32(1) << rng.integers(0, 32, 500).astype(np.uint32))
    of = lambda x: {(i, a) for i, a in zip(*(y.tolist() for y in simhash.anchors(x)), strict=True)}
    a, b = of(half), of(near)
    assert {i for i, _ in a & b} == set(range(500))
    assert max(Counter(i for i, _ in a).values()) <= 17


def test_large_group_of_near_copies_gives_few_links():
    base = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(np.array([int(base) ^ (1 << i) ^ (1 << j) for i in range(32, 64) for j in range(32, i)], np.uint64)).view(np.int64)
    a, b = simhash._links(np.arange(len(fps)) == 0, fps, 3)
    assert len(a) < 2 * len(fps)
    nodes, roots = forest(a, b)
    assert len(nodes) == len(fps) - 1 and len(set(roots.tolist())) == 1


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(0, i) for i in range(1, 50)]
    edges = chain + hub + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 0 for i in range(1, 50)} | {301: 300}


# Tokens


@pytest.mark.parametrize(("name", "file", "end"), [("op4_token_ids", "byte_bpe_50k.json", 0), ("op10_packing", "word_bpe_49k.json", 2)])
def test_tokens_and_pieces_equal_whole_text_encoding(spark, cases, case_rows, name, file, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(file))
    placed = lambda text: (xxhash.xxh64_intdigest(text, 42) + 2**63) % 2**64  # noqa: E731  as Spark's signed hash orders
    order = sorted(case_rows, key=lambda r: (r[0] is not None, r[0] or 0, placed(r[1] or ""), r[1] is not None))
    want, at = [], 0
    for doc, text, *_ in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        if name == "op4_token_ids":
            want.append((doc, at, len(ids), crc(ids)))
        else:
            done = 0
            while done < len(ids):
                sequence, offset = divmod(at + done, 4096)
                n = min(len(ids) - done, 4096 - offset)
                want.append((doc, done, n, crc(ids[done : done + n]), len(ids), sequence, offset))
                done += n
        at += len(ids)
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] if name == "op4_token_ids" else ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(map(tuple, QUERIES[name](spark, cases).select(columns).collect())) == Counter(want)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_the_library_on_odd_texts(file):
    import random

    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["a", "B", "é", "ß", "×", "÷", " ", "  ", "\n", "\t", "\r\n", "'s", "'t", "1", "23", ".", ",", "<|endoftext|>", "<|startoftext|>", "<", "|>", "中", "́", "İ", "ﬁ", "\x1c", "\x85", "\xa0", "_", "“", "😀", "'", "Ō", "Σ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, ""]
    plain = Tokenizer.from_file(vocabulary(file))
    with open(vocabulary(file), encoding="utf-8") as f:
        memo = tokens.MemoTokenizer(f.read())
    for begin in range(0, len(texts), 300):
        some = texts[begin : begin + 300]
        ids, bounds = memo.encode(pa.array(some, pa.string()))
        for k, text in enumerate(some):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_memo_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(tokens, "hash_octets", lambda size, spans: np.full(len(size), 7, np.uint64))
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        memo = tokens.MemoTokenizer(f.read())
    for text in ("one two three two one", "three one four", "a" * 30 + " bb " + "b" * 40):
        assert memo.encode(pa.array([text]))[0].tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def morse(n, swap):
    """2 ** n letters whose sums of powers of any odd base agree modulo 2 ** 64 for both values of swap, from n = 11 on."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(1 << n))


def test_alike_strings_have_their_own_ids():
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with open(vocabulary(file), encoding="utf-8") as f:
            memo = tokens.MemoTokenizer(f.read())
        for n in (10, 11, 12):
            texts = [morse(n, 0), morse(n, 1)]
            ids, bounds = memo.encode(pa.array(texts))
            for k, text in enumerate(texts):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_hashes_are_those_of_the_words():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    starts = np.sort(rng.choice(19_000, 3000))
    ends = starts + rng.integers(0, 140, 3000)
    raw, seen = data.tobytes(), {}
    assert words.xxh64(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends, strict=True)]
    for a, b, h in zip(starts.tolist(), ends.tolist(), words.span_hashes(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(h, raw[a:b]) == raw[a:b]
    hashes = {h for n in (10, 11, 12) for s in (0, 1) for h in words.span_hashes(np.frombuffer(morse(n, s).encode(), np.uint8), np.array([0]), np.array([1 << n])).tolist()}
    assert len(hashes) == 6


def test_memo_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO_PIECES", 50)
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        memo = tokens.MemoTokenizer(f.read())
    for k in range(20):
        text = " ".join(f"w{i}" for i in range(k * 17, k * 17 + 40))
        ids, _ = memo.encode(pa.array([text]))
        assert ids.tolist() == memo.tokenizer.encode(text).ids


def test_shards_prune_and_carry_metadata(spark, cases):
    import pyarrow.parquet as pq

    path = new_folder(spark, "tokens")
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens.write_shards(read(spark, cases), f.read(), 0, path)
    plan = tokens.read_shards(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    from pathlib import Path

    file = max(Path(path.removeprefix("file:")).glob("shards/part-*"), key=lambda p: p.stat().st_size)
    group = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"]
    assert "RLE_DICTIONARY" in encodings[next(x for x in encodings if x.startswith("ids"))]
    assert group.column(0).has_column_index


def test_padding():
    assert [packing.padded_length(n) for n in (1, 2, 3, 1025, 4096)] == [1, 2, 4, 2048, 4096]


def test_pieces_carry_their_ids(spark, cases):
    out = packing.pack(read(spark, cases), packing.word_vocabulary())
    wrong = out.where((F.size("ids") != F.col("length")) | (F.col("offset") + F.col("length") > 4096))
    assert wrong.count() == 0
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert sums.where("n <> top").count() == 0
    assert sums.where("n < 4096").count() <= 1


# Substring dedup


@pytest.mark.parametrize("window", [5, 6, 35])
def test_repeats_equal_counting_all_windows(spark, case_rows, window):
    rows = [(r[0], r[1]) for r in case_rows]
    texts = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    want = Counter()
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want[doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert Counter(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept_text").collect())) == want
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10, 6)


def plain_repeats(rows, window):
    texts = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    want = Counter()
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want[doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return want


def _answers(runs):
    parts = set(runs.column("part").to_pylist())
    return pa.concat_tables([substring_dedup._confirm((pa.scalar(p),), runs.filter(pa.compute.equal(runs.column("part"), p))) for p in parts])


def test_only_equal_words_are_repeats(spark, monkeypatch):
    """Words whose sums of powers agree, and windows whose hashes all agree."""
    some = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*some[:20], morse(11, 0), *some[20:40]])), (2, " ".join([*some[:20], morse(11, 1), *some[20:40]])), (3, " ".join(some)), (4, " ".join(some[10:55])), (5, " ".join(reversed(some)))]
    out = lambda: Counter(map(tuple, substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", "n_words", "n_removed", "kept_text").collect()))
    assert out() == plain_repeats(rows, 35)
    table = pa.table({"bucket": pa.array([0] * 5, pa.int32()), "doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda hashes, size: np.full(max(len(hashes) - size + 1, 0), 1 << 63, np.uint64))
    key = (pa.scalar(0),)
    hits = substring_dedup._hits(key, substring_dedup._probe(key, table, 18, 45, 3))
    runs = substring_dedup._extend(key, table, hits, 18, 35, 45, 3)
    found = substring_dedup._finish(key, table, _answers(runs), 18, 35, 45, 3).select(["doc_id", "n_words", "n_removed", "kept_text"]).to_pylist()
    assert Counter(tuple(r.values()) for r in found) == plain_repeats(rows, 35)


def test_repeats_under_one_id_and_in_copies(spark):
    rows = [(None, " ".join(f"x{i * 37 % 101 + k}" for i in range(80))) for k in range(30)] + [(None, "same words again and " * 20)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs, bucket_bytes=500)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect())) == plain_repeats(rows, 35)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_packed_sets_round_trip():
    rng = np.random.default_rng(1)
    for high in (3, 2**20, 2**40, 2**63):
        keys = np.unique(rng.integers(0, high, 500, dtype=np.uint64))
        assert np.array_equal(substring_dedup.unpack(substring_dedup.pack(keys)), keys)
    assert len(substring_dedup.unpack(substring_dedup.pack(np.empty(0, np.uint64)))) == 0


# Decontamination


def test_a_large_benchmark_gives_the_same(spark, cases):
    docs, items = read(spark, cases), spark.read.parquet(f"{cases}/benchmark.parquet")
    key = lambda r: str((r.doc_id, r.n_words, r.n_hit, r.items, r.hits))
    whole = sorted(map(key, decontaminate.contamination(docs, items).collect()))
    assert sorted(map(key, decontaminate.contamination(docs, items, block_windows=3).collect())) == whole
    clean = decontaminate.drop_contaminated(docs, items, block_windows=3)
    assert clean.columns == docs.columns
    assert clean.count() == sum("items=[]" in x or ", []," in x for x in whole)


# Language


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf).select("doc_id", "lang")
    got = QUERIES["op7_language"](spark, sf).join(docs, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_hand_cases(spark, cases, case_rows):
    got = QUERIES["op7_language"](spark, cases).collect()
    assert len(got) == len(case_rows)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    by_text = dict(zip([r[0] for r in case_rows], [r[1] for r in case_rows], strict=True))
    for r in got:
        if r.doc_id is not None and r.doc_id != case_rows[13][0]:
            text = by_text[r.doc_id]
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))), repr(text)[:80]
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_no_labels_no_languages(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, docs).collect()] == [("und", 0.0)]


def test_forward_backward_equals_all_labellings():
    import itertools

    rng = np.random.default_rng(4)
    seen, first, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    chance, pairs, _, _ = language._chains(seen, first, moves)
    total, want, want_pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for y in itertools.product(range(3), repeat=4):
        p = np.exp(first[y[0]] + sum(seen[0, t, y[t]] for t in range(4)) + sum(moves[y[t], y[t + 1]] for t in range(3)))
        total += p
        for t in range(4):
            want[t, y[t]] += p
        for t in range(3):
            want_pairs[y[t], y[t + 1]] += p
    assert np.allclose(chance[0], want / total) and np.allclose(pairs, want_pairs / total)


EN = ["the cat sat on that mat with this hat and then went there", "that thing with the other one was thought through by them"] * 8
DE = ["der hund und die katze sind nicht mehr hier gewesen", "ich habe keine ahnung warum das nicht geht und wohin"] * 8


def test_code_switched_words_are_labelled(spark):
    model = language.train(EN + DE, ["en"] * 16 + ["de"] * 16)
    scorer = language._Scorer(model)
    mixed, pure = scorer.documents(pa.array(["the cat with that hat und die katze sind nicht", "the cat with that hat"])).chance
    assert pure[model.languages.index("en")] > 0.9
    assert 0.3 < mixed[model.languages.index("en")] < 0.7
    text = "é 12 the cat with that hat, und die katze sind nicht"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "..."), (4, "the cat with that hat 7")], "doc_id long, text string")
    got = {r.doc_id: [(text[x.start : x.end] if r.doc_id == 1 else (x.start, x.end), x.lang) for x in r.runs] for r in language.label_words(docs, model).collect()}
    assert got[2] == got[3] == [] and got[4] == [((0, 23), "en")]
    assert got[1][-2:] == [("the cat with that hat", "en"), ("und die katze sind nicht", "de")] or got[1] == [("é 12 the cat with that hat", "en"), ("und die katze sind nicht", "de")]
    assert {r.doc_id: r.n_runs for r in language.predict(docs, model).collect()} == {k: len(v) for k, v in got.items()}


def test_long_chains_in_stretches_give_the_same(monkeypatch):
    model = language.train(EN + DE, ["en"] * 16 + ["de"] * 16)
    texts = pa.array([" ".join(EN + DE * 2 + EN), None, "the cat", " ".join(DE[:3]), "", "12 13"])
    want = language._Scorer(model).documents(texts, label=True)
    for cells in (40, 300):
        monkeypatch.setattr(language, "_CELLS", cells)
        got = language._Scorer(model).documents(texts, label=True)
        assert np.allclose(got.chance, want.chance, atol=1e-5)
        assert got.labels.tolist() == want.labels.tolist() and got.count.tolist() == want.count.tolist()
        assert got.quads.tolist() == want.quads.tolist() and got.seen.tolist() == want.seen.tolist()


def test_long_texts_by_blocks_give_the_same(monkeypatch):
    model = language.train(EN + DE, ["en"] * 16 + ["de"] * 16)
    rng = np.random.default_rng(8)
    texts = pa.array([" ".join(rng.choice(" ".join(EN + DE).split(), n)) for n in (599, 600, 601, 1000, 3137, 40, 1)])
    monkeypatch.setattr(language, "_MOST_BLOCKED", 0)
    want = language._Scorer(model).documents(texts, label=True)
    monkeypatch.setattr(language, "_MOST_BLOCKED", 32)
    for least in (1, 2, 600):
        monkeypatch.setattr(language, "_LONG", least)
        got = language._Scorer(model).documents(texts, label=True)
        assert np.allclose(got.chance, want.chance, atol=1e-4) and (got.labels != want.labels).mean() < 1e-3


def test_scoring_a_batch_takes_little_memory():
    import tracemalloc

    model = language.train(["the cat sat on that mat"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    scorer = language._Scorer(model)
    texts = pa.array(["the cat and der hund " * 200] * 1500)
    tracemalloc.start()
    scorer.documents(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 46_000_000, peak


def test_sample_keeps_every_language(spark):
    rows = [(7, f"ein text {i}", "de") for i in range(900)] + [(1000 + i, f"a text {i}", "en") for i in range(300)] + [(None, f"un texto {i}", "es") for i in range(300)]
    rows += [(8, "equal rows", "fr")] * 300 + [(9, None, "en"), (10, "no label", None), (11, "rare", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(language.sample(docs)[1]) == {"de": 200, "en": 200, "es": 200, "fr": 200, "xx": 1}
    some = language.sample(docs, language.Training(per_language=5, languages=2))
    assert Counter(some[1]) == {"de": 5, "en": 5}
    assert language.sample(docs.repartition(7), language.Training(per_language=5, languages=2)) == some


def test_sample_of_long_texts_is_bounded(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 30000) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    short = spark.createDataFrame([(100, "a short text", "en"), (101, "ein kurzer text", "de")], "doc_id long, text string, lang string")
    texts, labels = language.sample(docs.unionByName(short))
    assert Counter(labels) == {"en": 21, "de": 21} and {"a short text", "ein kurzer text"} <= set(texts)
    assert sum(map(len, texts)) <= 4_000_000 and min(len(x) for x in texts if "word" in x) > 90_000
    whole = docs.where("doc_id < 4").collect()
    assert sorted(language.sample(docs.where("doc_id < 4"))[0]) == sorted(r.text for r in whole)


def test_texts_like_none_that_was_learned_go(spark):
    docs = read(spark, "/root/testdata/sf0.01").where("lang is not null").orderBy("doc_id").limit(900)
    model = language.train(*language.sample(docs.where(~language.held_out())))
    rng = np.random.default_rng(2)
    junk = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxzq"), 7)) for _ in range(80)) for _ in range(20)]
    other = ["moniä öitä valvottuaan hän näki äkkiä jotakin, mikä sai hänet pysähtymään: vanha myllynkivi kyljellään heinikossa " * 2] * 20
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(junk + other)], "doc_id long, text string")
    assert language.prevailing(odd, model).count() <= 20
    assert language.prevailing(odd.where("doc_id < 20"), model).count() == 0
    clean = docs.where("length(text) > 200")
    assert language.prevailing(clean, model).count() >= 0.995 * clean.count()


# Secrets and personal data


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == ("all", (b"abc", b"bcd"))
    assert secrets.trigram_query("(abc|xyz)+q") == ("any", (b"abc", b"xyz"))
    assert secrets.trigram_query("(abc|x?)") is None
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("a[Bb]c") == b"abc"
    assert secrets.trigram_query("(?i)token") is None and secrets.trigram_query("abc(?i:key)") == b"abc"


def test_index_loses_no_match(spark, cases):
    docs = read(spark, cases)
    rules = (secrets.Rule("a", "erathe[0-9]+"), secrets.Rule("b", "(?:Straße|niño)1"), secrets.Rule("c", "[0-9]{5,}"))
    got = {(r.doc_id, tuple(map(tuple, r.spans))) for r in secrets.find_secrets(docs, rules).collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        want.add((r.doc_id, tuple(sorted((m.start(), k, m.end()) for k, p in (("a", "erathe[0-9]+"), ("b", "(?:Straße|niño)1"), ("c", "[0-9]{5,}")) for m in re.finditer(p, r.text or "")))))
    assert got == want


def test_masking():
    assert secrets.masked("ab secret cd", [(3, "x", 9)]) == "ab [x] cd"
    assert secrets.masked("0123456789", [(1, "a", 4), (3, "b", 6), (8, "c", 9)]) == "0[a]67[c]9"


def test_validators(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB82 WEST 1234 5698 7654 33")], "a string, b string")
    assert [tuple(r) for r in df.select(pii.luhn(F.col("a")), pii.mod97(F.col("b"))).collect()] == [(True, True), (False, False)]


def test_numbers_end_with_their_country(spark):
    lines = ["ES91 2100 0418 4502 0005 1332 BIC X", "ES9121000418450200051332 BIC", "AT611904300234573201 BIC", "SE45 5000 0000 0583 9825 7466 2024", "XX45 5000 0000 0583 9825 7466"]
    got = pii.find_personal(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[lines[r.doc_id][x.start : x.end] for x in r.spans if x.kind == "iban"] for r in got] == [["ES91 2100 0418 4502 0005 1332"], ["ES9121000418450200051332"], ["AT611904300234573201"], ["SE45 5000 0000 0583 9825 7466"], []]


def test_context_words_stand_alone_and_adjust_scores(spark):
    lines = ["my ssn 219-09-9998", "antisocial 219-09-9998", "ssn 666-09-9998, 900-11-1111, 123-00-1234, 123-45-0000", "the ip 1.2.3.4", "the ship 1.2.3.4", "no word " + "x" * 41 + " 1.2.3.4", "1.2.3.4 server"]
    got = pii.find_personal(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(x.kind, x.score, x.context) for x in r.spans] for r in got] == [[("social", 70, True)], [], [], [("ip", 90, True)], [("ip", 50, False)], [("ip", 50, False)], [("ip", 90, True)]]


def test_many_matches_take_linear_time(spark, ends):
    many = 40_000
    text = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(many))
    found = pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(x.start, x.end) for x in found] == [m.span() for m in re.finditer(r"\S+", text)]


@pytest.mark.parametrize("module", ["quality", "pii"])
def test_native_operators_run_no_python(spark, cases, module):
    out = {"quality": quality.op1_quality, "pii": pii.op3_personal_data}[module](spark, cases)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_gives_clean_texts(spark, cases):
    out = quality.quality(read(spark, cases)).where("n_removed_lines > 0")
    assert out.count() > 20
    assert out.where("clean_text like '%SAME terms%'").count() == 0


def test_long_texts_sort_pairs(spark):
    text = " ".join(str(i) for i in range(1 << 17)) + " 5 6 7 8"
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert quality.quality(docs).first().n_repeat_words == 8


def test_rows_of_one_document_count_once(spark):
    line = "a line that many documents hold in common"
    rows = [(i % 7, f"{line}\nother words {i}", "s") for i in range(60)] + [(None, f"{line}\nagain", "s")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lambda most: {r.n_docs for r in quality.frequent_lines(docs, most).collect()}
    assert found(7) == {8} and found(8) == set()


def test_windows_that_only_share_a_hash_are_no_repeats(spark, monkeypatch):
    texts = ["a b c d e f a b x c d e", "one two three one two three four", " ".join(f"w{i % 50}" for i in range(400)), "q r s t"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        want[i] = len({k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)})
    got = lambda: {r.doc_id: r.n_repeat_words for r in quality.base_features(docs).collect()}
    assert got() == want
    plain = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *x: plain(*x) * 0 + 5 if len(x) == 3 and not any(isinstance(y, str) for y in x) else plain(*x))
    assert got() == want


# Fixity


def test_records_without_offsets_and_many_at_one(spark):
    rows = [(1, None, f"loose {i}") for i in range(300)] + [(1, 0, f"same place {i}") for i in range(50)] + [(2, None, "x")] * 40 + [(None, 5, "y")]
    make = lambda some: spark.createDataFrame(some, "file long, offset long, record string")
    assert merkle.audit(make(rows), make(rows[::-1]), span=10, fan=4).count() == 0
    hurt = [r for r in rows if r[2] not in ("loose 7", "same place 3")] + [(1, None, "new")]
    hurt.remove((2, None, "x"))
    got = Counter((r.file, r.offset, r.status) for r in merkle.audit(make(rows), make(hurt), span=10, fan=4).collect())
    assert got == Counter([(1, None, "missing_b"), (1, None, "missing_a"), (1, 0, "corrupt"), (2, None, "corrupt")])
    plan = merkle.tree(merkle.digest_records(make(rows)), 1)[0]
    assert plan.where("node < 0").count() > 200


def test_long_items_are_no_block(spark):
    long = " ".join(f"i{k}" for k in range(60))
    docs = spark.createDataFrame([(d, f"x {' '.join(long.split()[d : d + 12])} y") for d in range(0, 50, 5)] + [(99, "clean words only " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "i3 i4"), (3, long)], "item_id long, text string")
    key = lambda r: str((r.doc_id, r.n_words, r.n_hit, r.items, r.hits))
    want = sorted(map(key, decontaminate.contamination(docs, items).collect()))
    assert decontaminate._block(items, 10, 5, 102) is None and len(decontaminate._block(items, 10, 5, 103).windows) == 52
    assert sorted(map(key, decontaminate.contamination(docs, items, block_windows=30).collect())) == want
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items, block_windows=30).collect()] == [99]


def test_audit_finds_each_kind_of_damage(spark):
    rows = [(f, o * 100, f"record {f} {o}" * 3) for f in range(3) for o in range(200)]
    good = spark.createDataFrame(rows, "file long, offset long, record string")
    hurt = [(f, o, "x" if (f, o) == (1, 500) else r) for f, o, r in rows if (f, o) != (2, 0)] + [(0, 999_999, "extra")]
    bad = spark.createDataFrame(hurt, "file long, offset long, record string")
    got = {(r.file, r.offset, r.status) for r in merkle.audit(good, bad, span=1000, fan=4).collect()}
    assert got == {(1, 500, "corrupt"), (2, 0, "missing_b"), (0, 999_999, "missing_a")}
    assert merkle.audit(good, good, span=1000, fan=4).count() == 0


# Pipeline


def test_pipeline_equals_a_plain_version(spark, cases, case_rows):
    import corpus_pipeline

    docs = read(spark, cases)
    kept = corpus_pipeline.language(spark, docs, cases)
    assert kept.columns == docs.columns
    found = language.identify(docs, docs.where(~language.held_out())).where("lang_pred <> 'und'")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found.collect())
    assert kept.where("score not like 'clash%'").count() == 0
    near = corpus_pipeline.near_copies(spark, kept, cases)
    ids = [r.doc_id for r in near.collect()]
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in kept.collect()]
    roots = plain_components([(a, b) for _, a in prints for _, b in prints if a < b and (a ^ b).bit_count() <= 3], {f for _, f in prints})
    groups = {}
    for doc, f in prints:
        if doc is not None:
            groups[roots[f]] = min(doc, groups.get(roots[f], doc))
    # One row a group: unlike texts that share an id are rows of their own.
    assert Counter(ids) == Counter(groups.get(root) for root in set(roots.values())) and near.columns == docs.columns
    clean = corpus_pipeline.benchmark(spark, near, cases)
    hit = {r.doc_id for r in decontaminate.contamination(near, spark.read.parquet(f"{cases}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == set(ids) - hit
    masked = corpus_pipeline.secrets(spark, clean, cases)
    assert masked.count() == clean.count()
    assert masked.where("text like '%deadbeefdeadbeef%' or text like '%hunter22%'").count() == 0
    pieces = corpus_pipeline.run(spark, cases)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in masked.collect()}


def test_stages_on_empty_and_null_tables(spark, nothing, cases):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, nothing).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nulls, cases)
        assert out.count() == {"language": 0, "near_copies": 1}.get(name, 3)


def test_near_copies_keep_one_row_of_each_group(spark, cases):
    import random

    import corpus_pipeline

    rng = random.Random(3)
    some = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d, e, f = (some() for _ in range(6))
    rows = [(5, a), (5, b), (7, a), (8, b), (3, c), (9, c), (9, d), (None, d), (None, e), (None, e), (None, f), (None, c), (6, e), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_copies(spark, docs, cases).collect())
    assert got == Counter([(5, a), (5, b), (3, c), (9, d), (6, e), (None, f), (None, "")])


def test_a_full_table_of_numbers_grows(ends):
    rng = np.random.default_rng(8)
    hashes = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    table = words.Numbers(4)
    for a in range(0, len(hashes), 700):
        table.add(hashes[a : a + 700])
        assert table.find(hashes[: a + 700]).tolist() == list(range(min(a + 700, len(hashes))))
        assert (table.find(hashes[a + 700 :]) == -1).all()
    full = words.Numbers(4)
    full.add(hashes[:16])
    assert full.find(hashes[:20]).tolist() == [*range(16), -1, -1, -1, -1]


def test_one_text_with_more_words_than_slots(monkeypatch, ends):
    text = " ".join(f"the{i} cat{i}" for i in range(300)) + " the cat sat"
    monkeypatch.setattr(tokens, "_MEMO_BITS", 5)
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        memo = tokens.MemoTokenizer(f.read())
    assert memo.encode(pa.array([text]))[0].tolist() == memo.tokenizer.encode(text).ids
    model = language.train(["the cat sat on that mat"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    want = language._Scorer(model).documents(pa.array([text])).chance
    monkeypatch.setattr(language, "Numbers", lambda bits: words.Numbers(5))
    assert np.array_equal(language._Scorer(model).documents(pa.array([text])).chance, want)


def test_masking_leaves_no_line_of_a_private_key(spark):
    import base64

    rng = np.random.default_rng(6)
    raw = base64.b64encode(rng.bytes(585)).decode()
    body = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    assert len(body[-1]) < 16
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC,0123456789ABCDEF", ""]
    certificate = ["-----BEGIN CERTIFICATE-----", "MIIBszCCAVmgAwIBAgIUQ", "-----END CERTIFICATE-----"]
    cases = [
        ("before\n" + "\n".join([head, *body, end]) + "\nafter", "before\n[private_key]\nafter"),
        ("before\r\n" + "\r\n".join([head, *body]) + "\r\nafter it", "before\r\n[private_key]\r\nafter it"),
        ("\n".join([head, *fields, *body]) + "\nThe text goes on.", "[private_key]\nThe text goes on."),
        ('{"key": "' + "\\n".join([head, *body, end]) + '\\n"}', '{"key": "[private_key]\\n"}'),
        ('x = "' + "\\n".join([head, *body]) + '\\n"', 'x = "[private_key]\\n"'),
        ("\n".join([head, *body, *certificate]), "\n".join(["[private_key]", *certificate])),
        ("\n".join([head, *body, head, *body, end]), "[private_key]\n[private_key]"),
        (" ".join([head, *body, end, "and so on"]), "[private_key] and so on"),
        ("\n".join([head, *body[:3], body[3][:20]]), "[private_key]"),
        (f"a key begins with {head} and a few words follow, but no key", "a key begins with [private_key] and a few words follow, but no key"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.text for r in secrets.mask_secrets(docs).orderBy("doc_id").collect()] == [w for _, w in cases]


def test_bodies_of_private_keys_take_linear_time(ends):
    rule = next(r for r in secrets.ADDED if r.kind == "private_key")
    head = "-----BEGIN PRIVATE KEY-----"
    for text in (head * 20_000, head + "\n" * 500_000, (head + "\n" * 50) * 10_000, head + "A" * 500_000 + "-" * 500_000, head + "A b" * 300_000, head + "\nAAAAAAAAAAAAAAAA" * 30_000 + "\n" * 300_000 + "."):
        assert len(list(secrets._masked_spans(rule, re.compile(rule.pattern), text))) == text.count(head)


def test_reader_decodes_few_texts_at_once(spark, tmp_path):
    """A task holds all texts of a reader's batch: at 4096 rows a batch, texts of 600,000 characters ended the executor."""
    shared.bounded_batches(spark)
    spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    df.collect()
    todo, batches = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "ColumnarToRow":
            batches += node.metrics().get("numInputBatches").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert batches >= 1000 / shared.READ_ROWS
