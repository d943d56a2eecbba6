"""Packing, token files, repeated passages, near-duplicates and the pipeline: against brute force and round trips."""

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import _worker, encoding, neardup, packing, registry, substrings, token_files
from millrace.llm import components as components_module
from millrace.llm._shared import release
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

# --- token ids

PIECES = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "é", "É", "ß", "1", "23", ".", ",", "...", "#", "<|endoftext|>", "<|startoftext|>", " ", "́", "中文", "🙂", "\x85", "İ", "ǅ", "\xa0", "\r\n", "it's", "CAN'T", "\x1c", " 's", "«", "º", "\0", "the", " Ander,"]


@pytest.mark.parametrize(("path", "drops_space"), [(BYTE, False), (WORDS, True)])
def test_chunked_encoding_is_the_library_encoding(path, drops_space):
    rng = random.Random(1)
    e = encoding.Encoder(path, drops_space)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for t in [*texts, "", None]:
        want = e.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert e.encode(t) == want, repr(t)
    for together in (1, 200, 1 << 20):
        encoding.TOGETHER, kept = together, encoding.TOGETHER
        column = pa.array([*texts[:300], None, ""]).slice(7)
        for first, last, ids, bounds in e.encode_batch(column, 9):
            for k in range(first, last):
                want = e.tokenizer.encode(column[k].as_py() or "", add_special_tokens=False).ids
                assert ids[bounds[k - first] : bounds[k - first + 1]].tolist() == [*want, 9]
        assert last == len(column)
        encoding.TOGETHER = kept


@pytest.mark.parametrize(("path", "drops_space"), [(BYTE, False), (WORDS, True)])
def test_corpus_texts_have_the_library_encoding(spark, path, drops_space):
    e = encoding.Encoder(path, drops_space)
    column = pa.array([r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()])
    want = e.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)
    for first, _, ids, bounds in e.encode_batch(column, 7):
        for k, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            assert ids[a:b].tolist() == [*want[first + k].ids, 7]


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "MEMORY", 10)
    e = encoding.Encoder(BYTE, False)
    texts = [" ".join(f"w{i}" for i in range(k, k + 5)) for k in range(100)]
    first = [e.encode(t) for t in texts]
    assert len(e.hashes) <= 10 and len(e.ids) <= 60 and [e.encode(t) for t in texts] == first


def test_a_worker_serves_one_operator_at_a_time():
    _worker.begin("one")
    assert _worker.held("k", list) is _worker.held("k", list)
    kept = _worker.held("k", list)
    _worker.begin("one")
    assert _worker.held("k", list) is kept
    _worker.begin("two")
    assert not _worker._held and _worker.held("k", list) is not kept


# --- packing


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def visit(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in tried:
                tried.add(bins[j])
                bins[j] += items[i]
                visit(i + 1, bins)
                bins[j] -= items[i]
        bins.append(items[i])
        visit(i + 1, bins)
        bins.pop()

    visit(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest():
    rng = random.Random(3)
    for t in range(150):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(1, capacity) if t % 3 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(0, 10))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
        solution = packing.solve(counts, capacity)
        used = np.zeros(capacity + 1, int)
        for filling, n in solution:
            assert sum(filling) <= capacity and n > 0
            for x in filling:
                used[x] += n
        n = sum(k for _, k in solution)
        assert (used == counts).all() and packing.lower_bound(counts, capacity) <= n == fewest(items, capacity)


def test_bin_completion_beats_best_fit():
    counts = np.bincount(np.random.default_rng(1).integers(900, 1500, 3000), minlength=4097)
    total = lambda s: sum(n for _, n in s)
    solution = packing.solve(counts, 4096)
    assert total(solution) < total(packing.best_fit(counts, 4096))
    assert packing.report(counts, 4096, solution) == packing.Report(total(solution), total(packing.best_fit(counts, 4096)), packing.lower_bound(counts, 4096))
    assert not packing._dominated((5, 4), (8,)) and packing._dominated((5, 4), (9,)) and packing._dominated((3, 2, 2), (5, 2))


def check_packed(rows, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(spark, odd, empty):
    tokenizer = encoding.Encoder(WORDS, True).tokenizer
    for docs in (spark.read.parquet(f"{SF}/documents.parquet").repartition(3), odd):
        rows = packing.pack_documents(docs).collect()
        want = defaultdict(int)
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            for k, i in enumerate(range(0, len(ids), 4096)):
                want[r["doc_id"], k, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())] += 1
        got = defaultdict(int)
        for r in rows:
            got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        assert got == want
        n, total = check_packed(rows), sum(r["length"] for r in rows)
        assert n <= -(-total // 4096) + 1
    assert packing.pack_documents(empty).count() == 0


def test_hot_lengths_are_numbered_in_parts(spark):
    pieces = spark.range(3000).selectExpr("id", "cast(if(id < 2000, 7, id % 50 + 1) as int) length").cache()
    rows = packing.pack(pieces, capacity=64, per_block=100).collect()
    assert len(rows) == 3000 and check_packed(rows, 64) >= -(-sum(r["length"] for r in rows) // 64)
    with pytest.raises(ValueError):
        packing.pack(pieces, capacity=20)


def test_sequences_hold_their_ids(spark, odd):
    pieces = packing.tokenize_pieces(odd, WORDS, capacity=50, keep_ids=True).cache()
    packed = packing.pack(pieces, order=("doc_id", "piece", "ids_crc32"), capacity=50).cache()
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(whole[r["sequence_id"]]["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_search_is_not_ended_by_the_width_of_its_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    used = lambda solution: sum(n for _, n in solution)
    widened = lambda c: used(packing.complete(c, 60, effort=packing.Effort(1, 1)))
    cases = [np.bincount(rng.integers(8, 31, int(rng.integers(9, 30))), minlength=61) for _ in range(300)]
    cases = [c for c in cases if used(packing.best_fit(c, 60)) > packing.lower_bound(c, 60)]
    want, got = [used(packing.solve(c, 60)) for c in cases], [widened(c) for c in cases]
    assert got == want
    monkeypatch.setattr(packing.Effort, "widen", lambda self: setattr(self, "spent", 10**9))  # the width ends it
    assert sum(map(widened, cases)) > sum(want)


# --- token files


def test_numbers_round_trip():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 2 ** rng.integers(1, 33), rng.integers(0, 40), dtype=np.uint64).astype(np.uint32) for _ in range(200)]
    sizes = np.array([len(d) for d in docs])
    control, data = token_files.encode_numbers(np.concatenate(docs), sizes)
    (c, cs), (d, ds) = token_files._bytes(control), token_files._bytes(data)
    for a, b in ((0, 200), (3, 90), (5, 5), (150, 200)):
        back = token_files.decode_numbers(c[cs[a] : cs[b]], d[ds[a] : ds[b]], sizes[a:b])
        assert back.tolist() == [int(x) for doc in docs[a:b] for x in doc]
    control, data = token_files.encode_numbers(np.array([1, 300, 70000, 2**31, 5], np.uint32), np.array([5]))
    assert control[0].as_py() == bytes([0b11100100, 0]) and data[0].as_py() == bytes([1, 44, 1, 112, 17, 1, 0, 0, 0, 128, 5])
    most = token_files.TOGETHER
    assert list(token_files._together(np.array([most, 1, 2, 3 * most, 1]))) == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_token_store(spark, odd, empty, tmp_path):
    tokenizer = encoding.Encoder(BYTE, False).tokenizer
    for k, docs in enumerate((spark.read.parquet(f"{SF}/documents.parquet").repartition(3), odd)):
        tokens = token_files.tokenize(docs, BYTE, False, 0).cache()
        token_files.write_tokens(tokens, str(tmp_path / f"t{k}"))
        got = token_files.read_tokens(spark, str(tmp_path / f"t{k}"), with_ids=True).collect()
        want = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            want[r["doc_id"]].append(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
            want[r["doc_id"]].remove(bytes(r["ids"]))
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert not any(want.values()) and ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        ranks = spark.read.parquet(str(tmp_path / f"t{k}/ranks")).orderBy("rank").collect()
        assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)
    token_files.write_tokens(token_files.tokenize(empty, BYTE, False, 0), str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- repeated passages


def repeats(docs, width):
    """(id, text) -> (number of words, kept words)."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for d, t in docs:
        for k in range(len(split(t)) - width + 1):
            w = tuple(split(t)[k : k + width])
            first[w] = min(first.get(w, (d, k)), (d, k))
    out = {}
    for d, t in docs:
        words = split(t)
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] != (d, k):
                gone |= set(range(k, k + width))
        out[d] = (len(words), [w for k, w in enumerate(words) if k not in gone])
    return out


@pytest.mark.parametrize(("load", "together"), [(250_000, 2_000_000), (40, 300), (3, 50)])
def test_repeats_against_brute_force(spark, prose, monkeypatch, load, together):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    rng = random.Random(load)
    passages = [prose(rng, n) for n in (25, 60, 20)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40))]
        if i % 3 == 0:
            parts += [passages[0], prose(rng, 5)]
        if i % 7 == 0:
            parts += [passages[rng.randrange(3)], "\n"]
        docs.append((i, "  ".join(parts)))
    docs += [(60, docs[3][1]), (61, "x " * 70), (62, None), (63, ""), (64, "a\xa0b " * 30), (65, "a\xa0b " * 30), (66, prose(rng, 19)), (-5, docs[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = repeats(docs, 20)
    got = substrings.remove_repeats(df, load=load).collect()
    assert len(got) == len(docs)
    for r in got:
        n, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, n - len(kept), " ".join(kept)), r["doc_id"]
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]
    laid = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(df, load=load, layout=True).collect()}
    named = df.select(F.concat(F.lit("n"), F.lpad((F.col("doc_id") + 10).cast("string"), 4, "0")).alias("doc_id"), "text")
    for r in substrings.remove_repeats(named.repartition(3), load=load).collect():
        assert r["kept_text"] == " ".join(want[int(r["doc_id"][1:]) - 10][1]), r["doc_id"]
    for d, t in docs:
        assert re.findall(r"[^\x20\x09-\x0D]+", laid[d] or "") == want[d][1]
        if len(want[d][1]) == want[d][0]:
            assert laid[d] == t


def test_repeats_with_odd_rows(spark, odd, empty):
    got = substrings.remove_repeats(odd, keep=odd.columns)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == odd.count()
    twice = odd.unionByName(odd)
    rows = {(r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(twice, keep=["doc_id", "text"]).collect()}
    assert rows == {(r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(odd, keep=["doc_id", "text"]).collect()}
    assert substrings.remove_repeats(empty).count() == 0


def test_smallest_of_runs():
    x = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    for span in (1, 2, 5, 17, 50):
        assert substrings._least(x, span).tolist() == [int(x[i : i + span].min()) for i in range(50 - span + 1)]


def test_op2(spark):
    rows = substrings.op2_substring_dedup(spark, SF).collect()
    want = repeats([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == {d: (n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, (n, k) in want.items()}


# --- near-duplicates


def near_classes(docs):
    """Smallest id of each document's class, by the weighted Jaccard similarity of all pairs, and the number of links."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    frequency = Counter(s for c in sets.values() for s in c)
    n = len(docs)
    weight = {s: 1 + 0.25 * round(7 * math.log(n / f) / math.log(n)) / 7 for s, f in frequency.items()} if n > 1 else dict.fromkeys(frequency, 1.25)
    total = {d: sum(k * weight[s] for s, k in c.items()) for d, c in sets.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        both = sum(min(k, sets[b][s]) * weight[s] for s, k in sets[a].items() if s in sets[b])
        if both and both >= 0.8 * (total[a] + total[b] - both):
            links += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, links


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_against_brute_force(spark, prose):
    rng = random.Random(11)
    docs, common = [], prose(rng, 30)
    base = prose(rng, 150)
    for _ in range(40):  # a group of near copies that are near their base, not always each other
        docs.append(edited(rng, base, rng.randint(0, 4)))
    for _ in range(15):
        t = prose(rng, rng.randint(30, 200))
        docs += [t, t, edited(rng, t, 1)]
    docs += [f"{prose(rng, 30)} {common} {prose(rng, 30)}" for _ in range(30)]
    docs += ["one two three", "one two three", "one two four", None, None, "", " "]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, links = near_classes(rows)
    got = {r["doc"]: r["class_id"] for r in neardup.find_classes(df).collect()}
    assert links > 100 and got == want
    kept = neardup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)


def test_counts_of_shingles_matter(spark, prose):
    """Repeated lines: what occurs more often weighs more, on both sides of the threshold."""
    rng = random.Random(13)
    docs = []
    for _ in range(25):
        body, line = prose(rng, rng.randint(40, 120)), prose(rng, 12)
        docs += ["\n".join([body, *[line] * k]) for k in rng.sample((1, 2, 3, 4, 5, 8, 10), 3)]
        docs.append("\n".join([edited(rng, body, 1), *[line] * 5]))
    rows = list(enumerate(docs))
    want, links = near_classes(rows)
    got = {r["doc"]: r["class_id"] for r in neardup.find_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links > 20 and len(set(want.values())) > 40 and got == want


@pytest.mark.parametrize(("rows", "size", "served"), [(6, 10**9, 3), (1000, 4000, 2048)])
def test_blocks_lose_no_link(spark, prose, monkeypatch, rows, size, served):
    for name, value in (("BLOCK", rows), ("BLOCK_BYTES", size), ("SERVED", served)):
        monkeypatch.setattr(neardup, name, value)
    rng, docs = random.Random(14), []
    for _ in range(3):  # chains, in which neighbours are similar and ends are not
        t = prose(rng, 120)
        for _ in range(14):
            docs.append(t)
            t = edited(rng, t, 2)
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want, links = near_classes(docs)
    got = {r["doc"]: r["class_id"] for r in neardup.find_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert links > 25 and got == want


def test_blocks_of_one_class_never_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    members = [(b"%3d" % i, b"g", b"big" if i < 95 else b"two" if i < 130 else b"s%d" % (i % 7), 1, b"") for i in range(144)]
    df = spark.createDataFrame(members, "key binary, `group` binary, root binary, size long, signature binary")
    rows = neardup._in_blocks(df).cache()
    met = neardup._meeting(rows, ("key", "root")).collect()
    by = defaultdict(lambda: (defaultdict(set), set()))
    for r in met:
        by[r["i"], r["j"]][0][r["side"]].add(bytes(r["key"]))
        by[r["i"], r["j"]][1].add(bytes(r["root"]))
    assert all(len(roots) > 1 for _, roots in by.values()) and max(len(k) for sides, _ in by.values() for k in sides.values()) < 30
    root = {m[0]: m[2] for m in members}
    together = set()
    for (i, j), (sides, _) in by.items():
        pairs = itertools.combinations(sorted(sides[0]), 2) if i == j else itertools.product(sides[0], sides[1])
        together |= {tuple(sorted(p)) for p in pairs}
    assert together >= {p for p in itertools.combinations(sorted(root), 2) if root[p[0]] != root[p[1]]}


@pytest.mark.parametrize("similar", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_bands(similar):
    """Pairs at a weighted similarity, with shingles of all levels and counts: nearly all share a band."""
    rng = np.random.default_rng(int(similar * 100))
    sampler, found, agree, exact, n = neardup.Sampler(neardup.BANDS * neardup.ROWS), 0, [], [], 150
    for _ in range(n):
        h = np.unique(rng.integers(0, 2**63, 230).astype(np.uint64))
        w = neardup.weight_of(rng.integers(0, neardup.LEVELS, len(h))) * rng.choice([1, 1, 1, 2, 5], len(h))
        order, inside = rng.permutation(len(h)), w.sum()
        apart = np.cumsum(w[order]) <= (1 - similar) * inside
        a = np.sort(np.concatenate((order[~apart], order[apart][::2])))
        b = np.sort(np.concatenate((order[~apart], order[apart][1::2])))
        x, y = sampler(h[a], w[a]), sampler(h[b], w[b])
        agree.append((x == y).mean())
        exact.append(w[order[~apart]].sum() / w.sum())
        found += bool((neardup.bands_of(x) == neardup.bands_of(y)).any())
    assert min(exact) >= similar - 1e-9 and abs(np.mean(agree) - np.mean(exact)) < 0.02
    assert found >= 0.98 * n


def test_samples_follow_weighted_similarity():
    rng = np.random.default_rng(6)
    sampler = neardup.Sampler(2000)
    h = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    w, v = rng.choice([1.0, 1.25, 2.5, 3.75], 60), rng.choice([1.0, 1.25, 2.5, 3.75], 60)
    agree = (sampler(h, w) == sampler(h, v)).mean()
    assert abs(agree - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_document_frequencies_are_those_of_all_documents(spark, prose):
    rng = random.Random(12)
    line = "this line is in very many of all documents"
    docs = [prose(rng, 20) + (" " + line if i % 3 == 0 else "") for i in range(600)]
    frequency = Counter(h for t in docs for h in neardup.shingles(t)[0].tolist())
    hashes = np.array(list(frequency), dtype=np.uint64)
    want = [1 + 0.25 * round(7 * math.log(600 / f) / math.log(600)) / 7 for f in frequency.values()]
    for parts in (1, 7):
        weights = neardup.count_documents(spark.createDataFrame([(t,) for t in docs], "_text string").repartition(parts))
        got = weights(hashes, np.ones(len(hashes), np.int64))
        same = np.abs(got - want) < 1e-12
        assert same.mean() > 0.99 and len(set(want)) > 2
    assert neardup._unpacked(neardup._packed(np.array([1, 300, 2**40]))).tolist() == [1, 300, 2**40]


def test_weights_are_made_in_little_memory():
    counters = np.random.default_rng(5).integers(0, 3 * 10**5, neardup.CELLS)
    blocks = {k: neardup._packed(counters[k * neardup.CELL_BLOCK :][: neardup.CELL_BLOCK]) for k in range(neardup.CELLS // neardup.CELL_BLOCK)}
    tracemalloc.start()
    level = neardup.Weights(10**6, neardup._table(blocks)).level
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    frequency = np.clip(counters - int(np.sort(counters)[len(counters) // 2]), 1, 10**6)
    assert (level == np.rint(np.clip(np.log(10**6 / frequency) / np.log(10**6), 0, 1) * (neardup.LEVELS - 1))).all()
    assert neardup._table({}).sum() == 0


def test_common_counters_are_taken_off():
    counters = np.full(neardup.CELLS, 50, np.int64)
    counters[:3] = (51, 1050, 10**6)
    level = neardup.Weights(10**6, counters).level
    assert level[0] == level[5] == 7 and level[1] == round(7 * 0.5) and level[2] == 0


def test_shared_and_missing_ids_name_no_two_classes(spark, prose):
    rng = random.Random(15)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(7, a), (7, b), (8, b), (None, c), (None, c), (None, d), (9, a), (None, None), (7, "")]
    got = neardup.find_classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    text = {hashlib.md5(t.encode()).digest(): t for t in (a, b, c, d, "")}
    by = defaultdict(set)
    for r in got:
        by[text[bytes(r["key"])]].add((r["class_id"], r["class_key"]))
    assert all(len(x) == 1 for t, x in by.items() if t) and len(by[""]) == 2 and len({k for x in by.values() for k, _ in x}) == len({k for x in by.values() for _, k in x}) == 6
    assert {7} <= {k for k, _ in by[a] | by[b] | by[""]}
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(7, a), (7, b), (None, c), (None, d), (None, None), (7, "")]))
    named = neardup.find_classes(spark.createDataFrame([("x", a), ("x", b), ("y", b)], "doc_id string, text string"))
    assert len({r["class_id"] for r in named.collect()}) == 2


def test_classes_with_odd_rows(spark, odd, empty):
    twice = odd.unionByName(odd)
    found = neardup.find_classes(twice)
    assert found.count() == 2 * odd.count()
    kept = neardup.keep_one(twice)
    assert kept.columns == odd.columns
    worded = [r["text"] for r in kept.collect() if (r["text"] or "").strip()]
    assert sorted(worded) == sorted({r["text"] for r in odd.collect() if (r["text"] or "").strip()})
    assert neardup.find_classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, **{200 + i: 200 for i in range(50)}}
    assert components(df.limit(0)).count() == 0


def test_rounds_of_components_leave_no_files(spark):
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in settings}
    release(spark)
    time.sleep(1)
    before, links = _shuffle_files(spark), [(k + 1, k) for k in range(40)]
    one_round = 7 * 16 * 2  # shuffles, their tasks, files of a task
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame(links, "u long, v long"))
        end = time.time() + 10
        while (left := _shuffle_files(spark) - before) > one_round and time.time() < end:  # Spark removes them in the background
            time.sleep(0.2)
        assert left <= one_round
        assert {r["root"] for r in found.collect()} == {0}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def _shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(components_module, "LINKS", 4)
    rng = np.random.default_rng(5)
    # Two stars with a common leaf, one of them around its largest node, and a sparse rest.
    links = [(0, i) for i in range(1, 900)] + [(5000, i) for i in range(899, 1700)] + [(6000 + int(a), 6000 + int(b)) for a, b in rng.integers(0, 800, (500, 2))]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    assert got == {x: find(x) for x in list(parent)}


# --- the whole


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        rows[name] = after.collect()
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            before = spark.createDataFrame(rows[name], docs.schema)
    assert 100 < len(rows["near_dedup"]) < len(rows["quality_rules"]) < docs.count()
    assert {r["doc_id"] for r in rows["substring_dedup"]} == {r["doc_id"] for r in rows["near_dedup"]}
    assert all(r["n_chars"] == len(r["text"]) for r in rows["substring_dedup"])
    want, _ = near_classes([(r["doc_id"], r["text"]) for r in rows["quality_rules"]])
    assert {r["doc_id"] for r in rows["near_dedup"]} == {d for d, c in want.items() if d == c}
    assert {r["doc_id"] for r in rows["packing"]} == {r["doc_id"] for r in rows["decontamination"]}
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, rows["packing"]))


def test_pipeline_stages_take_odd_and_empty_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = {"substring_dedup": docs.count(), "decontamination": docs.count(), "packing": docs.count(), "quality_rules": 0}.get(name)
            assert out.count() == n if n is not None else 0 <= out.count() <= docs.count(), name
            assert name == "packing" or (out.columns == docs.columns and not set(map(repr, out.drop("text", "n_chars").collect())) - set(map(repr, docs.drop("text", "n_chars").collect())))


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_scratch_follows_the_session(spark):
    from millrace.llm._shared import scratch, staged

    assert scratch(spark) == spark.conf.get("spark.checkpoint.dir")
    df = staged(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and all(scratch(spark).removeprefix("file:") in f for f in df.inputFiles())
