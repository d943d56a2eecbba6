"""Sharding, decontamination, quality rules, chat, WARC, language: against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, langid, neardup, quality, sharding, substrings, warc

SF = "/root/testdata/sf0.001"


# --- sharding


def one_jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one_and_moves_little():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 40, 41):
        assert sharding.jump(keys, n).tolist() == [one_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(b[a != b]) == {40} and (a != b).mean() < 0.05
    assert len(sharding.jump(keys[:0], 40)) == 0


def test_slots_have_no_gap(spark, odd, empty):
    df = spark.range(5000).withColumnRenamed("id", "k")
    placed = sharding.with_slots(sharding.assign_shards(df, "k", 5), "k", per_block=100)
    rows = placed.collect()
    for s in range(5):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine))) and len(mine) > 800
    rows = sharding.with_slots(sharding.assign_shards(odd, "doc_id", 3), "doc_id").collect()
    assert len(rows) == odd.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.with_slots(sharding.assign_shards(empty, "doc_id", 3), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "k", 0)


def test_written_shards(spark, tmp_path):
    df = spark.range(300).selectExpr("id k", "id * 2 v")
    sharding.write_shards(df, "k", 4, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    want = {r["k"]: r["shard"] for r in sharding.assign_shards(df, "k", 4).collect()}
    assert {r["k"]: r["shard"] for r in back.collect()} == want


def test_op5(spark):
    rows = sharding.op5_jump_shards(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(v) + 16, zlib.crc32(v)) for k, v in texts.items()}
    assert all(r["grown_shard"] in (r["shard"], 40) and r["law"] == "key" for r in rows)
    hashed = {r[0]: r[1] % 2**64 for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64(F.lit("shard"), "doc_id")).collect()}
    assert all((r["shard"], r["grown_shard"]) == (one_jump(hashed[r["doc_id"]], 40), one_jump(hashed[r["doc_id"]], 41)) for r in rows)
    for s in range(40):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = fold(t)
        for k in range(len(w) - width + 1) if len(w) >= width else range(bool(w)):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = fold(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= got
        out.append((d, len(w), sum(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_against_brute_force(spark, odd, prose):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 9, 10, 11, 30, 0, 1])] + [(None, "Un Autre, item: without id"), (9, None), (10, prose(rng, 12))]
    items.append((11, items[4][1]))
    docs = [(i, prose(rng, 60)) for i in range(30)]
    docs += [(30, "pre " + items[4][1].upper() + " post"), (31, items[0][1].replace(" ", "...")), (32, "UN autre -- item WITHOUT id!"), (33, None), (34, "")]
    docs += [(35, prose(rng, 5) + " " + " ".join(items[4][1].split()[5:18]) + " " + items[3][1] * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(docs, items)
    for limit in (1 << 20, 40, 1):
        found = decontaminate.find_contamination(df, bench, limit=limit)
        assert found._jdf.queryExecution().toString().count("+- MapInArrow") <= 4  # one in each of the printed plans
        got = found.collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == want
    texts = dict(docs)
    for r in got:
        cut = " ".join(texts[r["doc_id"]][a:b] for a, b in r["spans"])
        assert len(fold(cut)) == r["n_hit"]
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()
    assert decontaminate.find_contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("width", [1, 3, 5, 6, 10])
def test_windows_of_all_widths_against_brute_force(width):
    """Few different words, so that windows overlap, repeat and nearly match."""
    rng = random.Random(width)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(60):
        items = [(i, say(rng.randint(0, 25))) for i in range(rng.randint(0, 5))]
        scanner = decontaminate.Scanner([(str(i), decontaminate._words(t)) for i, t in items], width)
        text = say(rng.randint(0, 60))
        hit, found = scanner.scan(decontaminate._words(text))
        assert (int(hit.sum()), sorted(found)) == contamination([(0, text)], items, width)[0][2:]


# --- quality rules


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_measures_against_brute_force(spark, odd, empty, prose):
    rng = random.Random(6)
    texts = ["a b c d e f " * 2, "a b c d e", "a a a a a a", "l 1\nl 1\n\nl 1 \n", "x#*$ %&|<> y", "\x0b\x0c"] + [prose(rng, n) for n in (4, 40, 300)]
    texts += [t + "\n" + t[: len(t) // 2] + "\n" + t for t in texts[-2:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (df, odd):
        assert sorted((r[0] or "", *r[1:]) for r in quality.measure(docs).select("text", *columns).collect()) == sorted((r["text"] or "", *measures(r["text"])) for r in docs.select("text").collect())
    assert quality.measure(empty).count() == 0


def test_label_model_finds_accuracies():
    rng = random.Random(7)
    truth = [0.95, 0.9, 0.8, 0.6]
    patterns, right, total = Counter(), 0, 0
    rows = []
    for _ in range(20000):
        good = rng.random() < 0.8
        votes = tuple((1 if good else -1) * (1 if rng.random() < a else -1) for a in truth)
        patterns[votes] += 1
        rows.append((good, votes))
    model = quality.fit(sorted(patterns.items()))
    for good, votes in rows:
        right += (model.log_odds(votes) > 0) == good
        total += 1
    found = [g[2] for g in model.good]
    assert all(abs(f - a) < 0.05 for f, a in zip(found, truth, strict=True)) and abs(model.prior - 0.8) < 0.05
    assert right / total > 0.95


def test_quality_keeps_clean_and_drops_junk(spark, odd, empty, prose):
    rng = random.Random(8)
    sentence = lambda n: ". ".join(prose(rng, 9).replace(",", "").replace(".", "").capitalize() for _ in range(n)) + "."
    clean = [sentence(12) for _ in range(200)]
    junk = [" ".join(w + rng.choice(("###", "$$$", "%%%")) for w in prose(rng, 80).split()) for _ in range(25)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == set(range(200))
    judged = quality.judge(quality.measure(docs).drop("text").cache())
    for r in judged.limit(20).collect():
        assert 0 <= r["quality"] <= 1 and len(r["votes"]) == len(quality.RULES)
    out = quality.filter_quality(odd)
    assert out.columns == odd.columns and out.filter("text is null or text = ''").count() == 0
    assert quality.filter_quality(empty).count() == 0


def test_op7_runs_no_python(spark):
    plan = quality.measure(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = quality.op7_quality_rules(spark, SF).collect()
    assert len(rows) == 200 and all(not (r["base_failed"] and r["kept"]) for r in rows)
    # The verdict again, from votes that are cast in plain Python.
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    extra = {r["doc_id"]: r for r in quality.measure(spark.read.parquet(f"{SF}/documents.parquet")).collect()}

    def vote(rule, r):
        value = eval(re.sub(r"nullif\((\w+), 0\)", r"(\1 or float('nan'))", rule.measure), {}, {c: r[c] for c in quality.MEASURES} | {"float": float})
        if value != value:
            return 0
        return -1 if not rule.low <= value <= rule.high else int(rule.good_low <= value <= rule.good_high)

    votes = {d: tuple(vote(rule, extra[d]) for rule in quality.RULES) for d in texts}
    model = quality.fit(sorted(Counter(votes.values()).items()))
    for r in rows:
        odds = model.log_odds(votes[r["doc_id"]])
        assert abs(r["quality"] - 1 / (1 + math.exp(-odds))) < 1e-9
        words, _, _, _, repeated = measures(texts[r["doc_id"]])
        assert r["base_failed"] == (words < 10 or 100 * repeated > 20 * words) and r["kept"] == (not r["base_failed"] and odds >= 0)


# --- chat

NASTY = ["\\### Assistant: </turn> ok", "&lt;turn&gt;", "<turn>user<body>x</turn>\n", "&amp;lt;", "", "<image 0/>", "a\nb", "🙂é"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], NASTY[(c + t) % len(NASTY)]) for c in range(8) for t in range(5)]
    rows += [(None, 0, None, None), (9, 0, "assistant", "x"), (9, 0, "assistant", "x"), (10, None, "assi<stant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("formatted", F.lit("clash"))
    done = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    back = {r["conv_id"]: r for r in chat.read_chat(done).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(by)
    for c, turns in by.items():
        assert [tuple(x) for x in back[c]["turns"]] == [x[1:] for x in sorted(turns)]
        assert back[c]["trained"] == [x[2] for x in sorted(turns) if x[1] == "assistant" and x[2]]
    assert done.limit(0).count() == 0 and not re.search("Python|Arrow", done._jdf.queryExecution().toString())


def test_chat_parts(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    parts = [part("text", text="see <this> "), part("image", ref="i.png", width=28, height=15), part("text", text=" and "), part("audio", ref="a.wav", seconds=2.5), part("document", ref="d.pdf", pages=3), part("image")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="ok")]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df).head()
    assert r["formatted"] == "<turn>user<body>see &lt;this> <image 0/> and <audio 1/><document 2/><image 3/></turn>\n<turn>assistant<body>ok</turn>\n<turn>user<body></turn>\n"
    assert [(a["turn_index"], a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 0, "image", "i.png", 4), (0, 1, "audio", "a.wav", 63), (0, 2, "document", "d.pdf", 1536), (0, 3, "image", None, 0)]
    assert r["expanded_tokens"] == 1603


def test_op4(spark):
    rows = {r["conv_id"]: r for r in chat.op4_chat_format(spark, SF).collect()}
    text = NASTY[0]
    assert rows[-7]["n_turns"] == 2 and rows[-7]["loss_chars"] == len(text) and rows[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert rows[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 70000
    rows = [(1, "http://a/", "x" * 1500), (2, "http://b/?q=a b", "x" * 1500), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u\r\nEvil: 1", big), (6, "u", big), (7, "u", None), (8, "u", ""), (None, "http://ü/ x%20", "zz\r\n\r\n<"), (9, "again", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for chunk in (warc.CHUNK, 1000, 7):
        path = str(tmp_path / f"w{chunk}")
        warc.write_archives(warc.plan_records(df, "page_id", "url", "html"), path, chunk)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == len(rows) and all(r["whole"] for r in got)
        seen = sorted(((r["id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr)
        body = lambda t: (t or "").encode()
        sha = lambda t: hashlib.sha1(body(t)).hexdigest()
        kind = {1: ("revisit", 2), 5: ("revisit", 6)}
        assert seen == sorted(((i or 0, len(body(t)), sha(t), *kind.get(i, ("response", None))) for i, _, t in rows), key=repr)
        assert spark.read.parquet(path).agg(F.max(F.octet_length("body"))).head()[0] <= chunk + 1000
    assert {r["url"] for r in got if r["id"] in (None, 2, 3)} == {"http://%C3%BC/%20x%20", "http://b/?q=a%20b", None}
    archives = [r[0] for r in spark.read.parquet(path).select("archive").distinct().collect()]
    raw = b"".join((warc.export_archive(spark, path, a, str(tmp_path / "x.warc")), (tmp_path / "x.warc").read_bytes())[1] for a in archives)
    ids = re.findall(rb"WARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>", raw)
    assert len(ids) == len(rows) and len(set(ids)) == len(rows)
    assert set(re.findall(rb"WARC-Refers-To: <urn:uuid:([0-9a-f-]{36})>", raw)) <= set(ids)
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nEvil" not in raw and raw.endswith(b"\r\n\r\n")
    warc.write_archives(warc.plan_records(df.limit(0), "page_id", "url", "html"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_of_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "x" * 1500), (2, "b", "x" * 1500), (1, "c", "x" * 1500)], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df, "page_id", "url", "html"), str(tmp_path / "w"))
    got = sorted((r["id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]


# --- columns of any name


def test_kept_columns_keep_their_values(spark, odd):
    assert {"_here", "_key", "_stay_doc", "_block", "_k0", "score"} <= set(odd.columns)
    bench = spark.createDataFrame([(1, "some words in here")], "item_id long, text string")
    done = {
        "quality": quality.filter_quality(odd),
        "near": neardup.keep_one(odd),
        "repeats": substrings.cut_repeats(odd),
        "benchmark": decontaminate.drop_contaminated(odd, bench),
        "slots": sharding.with_slots(sharding.assign_shards(odd, "doc_id", 3), "doc_id"),
        "languages": langid.predict(odd, {}, odd.columns),
    }
    results = {"slots": {"shard"}, "languages": {"score", "lang_pred"}}
    for name, df in done.items():
        kept = [c for c in odd.columns if c not in results.get(name, ())]
        assert set(kept) <= set(df.columns) and len(set(df.columns)) == len(df.columns), name
        want = [tuple(r[c] for c in kept) for r in odd.collect()]
        rows = [tuple(r[c] for c in kept) for r in df.collect()]
        if name == "repeats":
            at = [kept.index(c) for c in ("text", "n_chars")]
            want, rows = ([tuple(v for i, v in enumerate(r) if i not in at) for r in x] for x in (want, rows))
        assert not set(rows) - set(want) and len(rows) <= len(want), name
        if name in ("repeats", "slots", "languages"):
            assert sorted(map(repr, rows)) == sorted(map(repr, want)), name


# --- languages


def told(rows, dimensions=langid.DIMENSIONS):
    """The whole query in plain Python: prototypes of the rows that aren't held out, and the best cosine of each text."""
    letters = langid.letter_vectors(dimensions).astype(int)

    def vector(text):
        symbols = [0]
        for c in text:
            low = c.lower()[:1]
            symbols.append(0 if not c.isalpha() else ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (64 - 27))
        symbols = [s for i, s in enumerate([*symbols, 0]) if i == 0 or s or ([*symbols, 0][i - 1])]
        out = np.zeros(dimensions, dtype=int)
        for gram, n in Counter(zip(symbols, symbols[1:], symbols[2:], strict=False)).items():
            out += n * np.roll(letters[gram[0]], 2) * np.roll(letters[gram[1]], 1) * letters[gram[2]]
        return out

    vectors = {d: vector(t or "") for d, t, _ in rows}
    names = sorted({lang for d, t, lang in rows if lang and t is not None and zlib.crc32(str(d).encode()) % 5})
    unit = lambda v: v / max(1e-12, np.linalg.norm(v))
    prototypes = [unit(sum(vectors[d] for d, t, x in rows if x == lang and t is not None and zlib.crc32(str(d).encode()) % 5)) for lang in names]
    centre = sum(prototypes) / len(prototypes)
    out = {}
    for d, t, _ in rows:
        cosines = [float(unit(p - centre) @ unit(unit(vectors[d]) - centre)) for p in prototypes]
        best = int(np.argmax(cosines))
        out[d] = (names[best], min(1.0, max(0.0, cosines[best]))) if any(c.isalpha() for c in t or "") else ("und", 0.0)
    return out


def test_op9_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = told(rows)
    for r in langid.op9_language_id(spark, SF).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, r["doc_id"]


def test_languages_within_bounds(spark, monkeypatch):
    """Texts of more 3-grams than are kept or added at once, and more languages than a task holds."""
    rng = np.random.default_rng(4)
    vectors, few = langid.GramVectors(64), langid.GramVectors(64)
    codes = np.unique(rng.integers(0, 64**3, 20000))
    counts = rng.integers(1, 9, len(codes))
    want = counts @ vectors._bound(codes).astype(int)
    monkeypatch.setattr(langid, "MEMORY", 5000)
    for part in np.array_split(np.arange(len(codes)), 7):
        few.add(codes[part], counts[part])
    assert (few.add(codes, counts) == want).all() and len(few.rows) <= 5000
    docs = spark.createDataFrame([(f"l{i % 50}", f"text {i} of some language l{i % 50}") for i in range(200)], "lang string, text string").coalesce(1)
    held = langid.learn(docs, dimensions=64)
    apart = langid.learn(docs.repartition(60, "lang"), dimensions=64)
    assert len(held) == 50 > langid.HELD and all((held[k] == apart[k]).all() for k in apart)



def test_gram_vectors_bind_permuted_letters():
    letters = langid.letter_vectors(64)
    codes = langid.gram_codes("Ab")
    assert codes.tolist() == [(0 * 64 + 1) * 64 + 2, (1 * 64 + 2) * 64 + 0]
    v = langid.GramVectors(64)(codes)
    assert (v[0] == np.roll(letters[0], 2) * np.roll(letters[1], 1) * letters[2]).all()
    counts = np.zeros(64**3, np.int64)
    counts[codes] = [2, 3]
    assert (langid.bundle(langid.GramVectors(64), counts) == 2 * v[0].astype(int) + 3 * v[1]).all()
    assert len(langid.gram_codes("")) == 0 and not langid.gram_codes(" 12 .").any()


def test_languages_held_out(spark):
    rows = langid.op9_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, odd, empty):
    prototypes = langid.learn(odd.withColumn("lang", F.when(F.col("doc_id") == 4, "aa").otherwise(F.col("lang"))))
    assert sorted(prototypes) == ["aa", "en"]
    again = langid.learn(odd.withColumn("lang", F.when(F.col("doc_id") == 4, "aa").otherwise(F.col("lang"))).repartition(5))
    assert all((again[k] == prototypes[k]).all() for k in prototypes)
    got = langid.predict(odd, prototypes, ["doc_id", "text", "key"]).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    assert {r["lang_pred"] for r in langid.predict(odd, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.learn(empty) == {} and langid.predict(empty, prototypes, ["doc_id"]).count() == 0
