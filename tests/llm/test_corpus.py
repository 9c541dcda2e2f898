"""Corpus operators on small tables: brute force, exact round trips, held-out rows, and the odd cases."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotwise.llm import decontamination, frames, html_text, near_copies, packing, quality, substrings, telephony, textkit, token_counts, tokens, toxicity
from plotwise.llm.cluster import written
from plotwise.llm.components import components
from plotwise.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
PATH = vocabulary()
LIB = Tokenizer.from_file(PATH)

#: Texts that trip things: nothing, white space, control signs, other scripts, special strings, one endless word.
ODD = [None, "", "  \n\t", "a", "two words", "<|endoftext|> in text<|startoftext|>", "ΣΑΣ İstanbul ﬁ Å", "x\x85y\x1cz\x0b w", "日本語テスト" * 300, "a\x00b", "don't I'LL", "é é ́", "w" * 5000, "😀👍🏽 ok", "1234 a1b2 ½²", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts twice, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 1, i, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 1, 3, "k"), (None, "no id here at all", None, None, None, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, spans string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- words, hashes, tokens


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in ODD]
    for block in textkit.blocks(pa.array(texts), 100):
        starts, ends, hashes, first = textkit.words(block, textkit.WHITE_TABLE)
        for d, row in enumerate(block.rows):
            got = [block.data[a:b].tobytes().decode() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", texts[row])
    one = textkit.words(next(textkit.blocks(pa.array(["Ab ab aB b"]))), textkit.WHITE_TABLE)[2]
    assert one[0] == one[1] == one[2] != one[3]


def test_distinct_numbers_every_entry():
    h = textkit.mix(np.random.default_rng(0).integers(0, 500, 20_000).astype(np.uint64))
    first, number = textkit.distinct(h)
    assert len(first) == 500 or len(first) == len(np.unique(h))
    assert (h[first][number] == h).all()


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
def test_block_ids_equal_the_library(size):
    texts = [t or "" for t in ODD]
    enc, at = tokens.Encoder(PATH, keep=50), 0
    for block in textkit.blocks(pa.array(texts), size):
        flat, offsets = enc.block(block, 1)
        for i in range(len(block.rows)):
            assert flat[offsets[i] : offsets[i + 1]].tolist() == ids_of(texts[at])
            at += 1
    assert at == len(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_vocabularies_that_keep_white_space_are_encoded_whole(name):
    enc, lib = tokens.Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    assert not enc.splits
    flat, offsets = enc.block(next(textkit.blocks(pa.array(["a b  c", ""]))))
    assert flat.tolist() == lib.encode("a b  c", add_special_tokens=False).ids and offsets[-1] == len(flat)


# ---- 3, 4, 9


def test_frames_round_trip(spark, odd, tmp_path):
    manifest = frames.write_frames(odd, PATH, f"file://{tmp_path}/f", frame_ids=64, files=3)
    rows = frames.read_frames(manifest, with_ids=True).orderBy("start").collect()
    want = sorted([(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3])], key=lambda x: x[0])
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    start = 0
    for r, (_, text) in zip(rows, want):
        ids = ids_of(text)
        assert (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (start, len(ids), crc(ids), ids)
        start += len(ids)
    some = frames.read_frames(manifest, wanted=spark.createDataFrame([(5,), (999,), (None,)], "doc_id long"), with_ids=True).collect()
    assert [(r.doc_id, list(r.ids)) for r in some] == [(5, ids_of(ODD[5]))]


def test_frames_are_independent_and_checked(tmp_path):
    import zstandard

    path = f"file://{tmp_path}/one.zst"
    writer = frames.FrameWriter(path, np.dtype("<u2"), frame_ids=10)
    data = [(k, np.arange(k * 7, dtype=np.uint16)) for k in range(6)]
    for k, ids in data:
        writer.add(k, ids)
    writer.close()
    reader = frames.FrameReader(path)
    assert [(k, ids.tolist()) for k, _, ids in reader.read()] == [(k, ids.tolist()) for k, ids in data]
    assert [ids.tolist() for _, _, ids in reader.read(np.array([4]))] == [data[4][1].tolist()]
    raw = bytearray((tmp_path / "one.zst").read_bytes())
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()  # any decoder skips index and table
    assert whole == np.concatenate([x for _, x in data]).astype("<u2").tobytes()
    raw[int(reader.frame_at[2]) + int(reader.seek[2, 0]) - 2] ^= 0xFF
    (tmp_path / "bad.zst").write_bytes(bytes(raw))
    with pytest.raises(Exception):
        list(frames.FrameReader(f"file://{tmp_path}/bad.zst").read())


def test_counts_equal_the_library(docs, odd):
    for df in (odd, docs):
        for r, text in [(r, r.text) for r in token_counts.token_counts(df, PATH, limit=20, buckets=5).join(df.select("doc_id", "text").dropDuplicates(), "doc_id").collect()]:
            assert r.n_tokens == len(ids_of(text)) - 1 and r.n_bytes == len((text or "").encode()) and r.over_limit == (r.n_tokens > 20)
    assert token_counts.token_counts(odd, PATH).count() == len(ODD) + 2
    model = token_counts.token_counts(odd.where("doc_id = 4"), vocabulary("piece_bpe_32k.model")).first()
    assert model.n_tokens > 0


def test_packing_covers_each_id_once(spark, odd):
    rows = packing.pack_powers_of_two(odd, PATH, longest=64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and all(r.offset == 0 for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.ids_crc32 == crc(r.ids)
        by[r.doc_id].append(r)
    for k, text in [*enumerate(ODD), (None, "no id here at all")]:
        ids = ids_of(text) * (2 if k == 3 else 1)
        assert [x for r in sorted(by[k], key=lambda r: (r.sequence_id if k == 3 else r.start)) for x in r.ids] == ids
    assert packing.pack_powers_of_two(odd.where("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_powers_of_two(odd, PATH, longest=100)


# ---- 1, 8, components


def brute_sets(texts, n):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute_components(sets, percent):
    low = {k: k for k in sets}
    keys = sorted(k for k in sets if sets[k])
    changed = True
    links = []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def near_texts():
    """Families with edits on both sides of the threshold, copies, common lines, and texts too short for an n-gram."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words, 12))
    texts = {}
    for f in range(5):
        base = list(rng.choice(words, int(rng.integers(30, 90))))
        for _ in range(25):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            texts[len(texts)] = " ".join(t)
    for _ in range(120):
        texts[len(texts)] = " ".join(rng.choice(words, int(rng.integers(1, 20)))) + " " + line
    for t in ("", None, "one", "ONE", "a b c", "A  b\nc", "d e"):
        texts[len(texts)] = t
    return texts


@pytest.mark.parametrize("n,percent,light,common", [(4, 85, 64, 32), (5, 80, 3, 4), (2, 60, 1, 2)])
def test_near_copies_equal_brute_force(spark, monkeypatch, n, percent, light, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    texts = near_texts()
    sets = brute_sets(texts, n)
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(3)
    # the limits reach the workers in their closures' module; a short limit sends lists to the leaders
    got = {r.doc_id: r for r in _with_light(near_copies.near_copies, light)(df, n, percent).collect()}
    want = brute_components(sets, percent)
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r.component_id for k, r in got.items()} == want


def _with_light(f, light):
    def run(*a):
        before = near_copies.candidates

        def long_lists(entries, rule):
            rule.light = light
            return before(entries, rule)

        near_copies.candidates = long_lists
        try:
            return f(*a)
        finally:
            near_copies.candidates = before

    return run


def test_near_copies_odd_rows(odd):
    rows = near_copies.near_copies(odd, 5, 80).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.component_id == r.doc_id or r.doc_id is None for r in rows)
    assert near_copies.near_copies(odd.where("false")).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_near_copies_of_repeated_ids(spark, turned):
    words = [f"w{i}" for i in range(60)]
    near, other, base = " ".join([*words, "x"]), " ".join(f"o{i}" for i in range(50)), " ".join(words)
    rows = [(1, near), (1, other), (2, base), (3, other + " end"), (4, "own words only here now"), (4, "own words only here now")]
    df = spark.createDataFrame([rows[1], rows[0], *rows[2:]] if turned else rows, "doc_id long, text string")
    got = near_copies.near_copies(df.withColumn("component_id", F.lit("clash"))).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("n,percent", [(1, 85), (1, 60)])
def test_lists_skip_blocks_and_lose_no_pair(n, percent):
    rule, rng = near_copies.Rule(n, percent), np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = rng.choice(5000, int(rng.integers(10, 60)), replace=False)
        sets += [np.unique(np.concatenate([base[: len(base) - int(rng.integers(0, 6))], rng.choice(5000, int(rng.integers(0, 9)))])) for _ in range(7)]
    rows = [(g, len(s), p, d) for d, s in enumerate(sets) for p, g in enumerate(s[: rule.front(len(s))].tolist())]
    gram, size, at, doc = np.array(sorted(rows)).T
    x, y, seen = near_copies.list_pairs(gram, size, at, rule)
    found = {tuple(sorted(p)) for p in zip(doc[x].tolist(), doc[y].tolist())}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if rule.links(sets[a], sets[b])}
    assert want and want <= found and (gram[x] == gram[y]).all()
    every = sum(k * (k - 1) // 2 for k in np.unique(gram, return_counts=True)[1])
    assert seen["skipped"] > 0 and seen["left"] > 0 and len(x) < every


def test_answers_of_followers_come_from_their_leaders(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 80, replace=False))
    copies = [" ".join([*base[:78], f"a{i}", f"b{i}"]) for i in range(80)]
    apart = [" ".join([*base[:30], *rng.choice(words, 36)]) for _ in range(5)]
    texts = dict(enumerate([*copies, *apart]))
    made = []
    before = near_copies.open_leaders
    monkeypatch.setattr(near_copies, "open_leaders", lambda *a: made.append((a[0], written(before(*a), "t"))) or made[-1][1])
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in _with_light(near_copies.near_copies, 3)(df, 2, 70).collect()}
    assert got == brute_components(brute_sets(texts, 2), 70)
    groups, still = made[0]
    assert groups.where("lead <> doc").count() > 0 and still.count() == 0  # what the leader shares with the others settles all copies


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51), (None, 3)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {}
    real = [(a, b) for a, b in links if a is not None and a != b]
    for a, b in real:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(len(real)):
        for a, b in real:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_substrings_find_planted_passages_and_leave_others(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    passages = [" ".join(word() for _ in range(60)) for _ in range(20)]
    own = lambda k: " ".join(word() for _ in range(k))
    texts = [f"{own(rng.integers(5, 80))} {passages[i % 20]} {own(rng.integers(5, 80))}" for i in range(60)] + [own(200) for _ in range(30)]
    texts += [own(3), texts[0], "", None, "日本語のテキスト" * 200, "日本語のテキスト" * 200 + "終"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substrings.drop_repeats(df).collect()}
    assert len(got) == len(texts)
    for i in range(60):
        assert (got[i].n_removed > 0) == (i >= 20), i
        if i >= 20:
            assert passages[i % 20] not in got[i].text and got[i].n_removed <= 62
            kept = texts[i].split()
            left = [w for j, w in enumerate(kept) if not any(a <= j < b for a, b in zip(got[i].removed[::2], got[i].removed[1::2]))]
            assert got[i].text.split() == left
    for i in [*range(60, 91), 92, 93]:
        assert got[i].n_removed == 0 and got[i].text == texts[i]
    assert len(got[91].text.split()) < substrings.UNIT_WORDS and got[91].n_removed + len(got[91].text.split()) == got[91].n_words
    assert got[95].n_removed > 0


def test_substrings_are_those_of_all_windows(spark):
    rng = np.random.default_rng(7)
    own = lambda k: [f"w{x}" for x in rng.integers(0, 10**9, k)]
    texts = []
    for i in range(40):
        passage = own(int(rng.integers(20, 60)))
        texts += [own(30) + passage + own(30), own(int(rng.integers(0, 9))) + passage + own(7)]
    texts += [own(3) + own(n) * 8 + own(3) for n in range(3, 13)] + [own(40) * 2, ["a"] * 19, ["a"] * 60]
    texts += [[f"x{x}" for x in rng.integers(0, 2, 300)]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        hit = set()
        for k in range(len(t) - 19):
            window = tuple(t[k : k + 20])
            hit |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        want[i] = hit
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for r in substrings.drop_repeats(df).collect():
        spans = r.removed or []
        assert {k for a, b in zip(spans[::2], spans[1::2]) for k in range(a, b)} == want[r.doc_id], r.doc_id
        assert r.text.split() == [w for k, w in enumerate(texts[r.doc_id]) if k not in want[r.doc_id]]


@pytest.mark.parametrize("least", [2, 5, 12, 20, 33])
def test_chunks_stand_in_every_repeat(least):
    rng = np.random.default_rng(least)
    own = lambda k: " ".join("abcdefghijklmnop"[: rng.integers(1, 9)] + str(rng.integers(50)) for _ in range(k))
    for _ in range(60):
        passage = own(least)
        block = next(textkit.blocks(pa.array([f"{own(30)} {passage} {own(9)}", f"{own(int(rng.integers(1, 9)))} {passage} {own(9)}"])))
        digests, doc, place, size = substrings.chunks(block, least)
        both = set(digests[doc == 0].tolist()) & set(digests[doc == 1].tolist())
        assert both and size.max() <= least


def test_substrings_repeated_ids_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 7, 5), (5, text, 8, 6), (5, text, 9, 7), (6, "own " + text[:40], 1, 8), (None, text, 2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, n_words int")
    got = substrings.drop_repeats(docs)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "removed"]
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (1, 0), (5, 60), (5, 60), (6, 0)]
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.n_removed, r.n_words) for r in kept.collect()) == [(0, 2, 9), (1, 7, 5), (6, 1, 8)]
    import corpus_pipeline

    assert corpus_pipeline.substring_dedup(spark, docs, SF).columns == docs.columns
    assert substrings.without_repeats(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        substrings.drop_repeats(docs, 1)


def test_substrings_without_white_space(spark):
    rng = np.random.default_rng(8)
    signs = lambda k: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, k))
    line = signs(40)
    rows = [(i, signs(int(rng.integers(60, 90))) + line * 30 + signs(80)) for i in range(4)]
    got = {r.doc_id: r for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i].text) < 60 + 90 + 80 + (700 if i == 0 else 120) for i in got)


def test_substrings_odd_rows(odd):
    rows = substrings.drop_repeats(odd)
    assert rows.columns == [*odd.columns, "n_words", "n_removed", "removed"]
    kept = {r.doc_id: r.text for r in rows.collect() if r.n_removed == 0}
    assert all(kept[k] == ODD[k] for k in (0, 1, 2, 3, 4, 5)) and rows.count() == len(ODD) + 2
    assert substrings.drop_repeats(odd.where("false")).count() == 0


# ---- 6


def test_windows_equal_brute_force(spark, odd):
    items = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (3, None), (4, "..."), (None, "lonely words here"), (2, "second row of two")]
    texts = ["The quick, brown fox jumps over the lazy dog again! And a SHORT item", "short-item short item", "quick brown fox", "lonely words here", "second row of two", None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    got = {r.doc_id: r for r in decontamination.overlaps(df, bench).collect()}
    for k, t in enumerate(texts):
        w, hit, names = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(10, len(iw))
            for i in range(len(w) - n + 1) if n else ():
                if any(w[i : i + n] == iw[j : j + n] for j in range(len(iw) - n + 1)):
                    hit |= set(range(i, i + n))
                    names |= set() if item is None else {str(item)}
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit)), t
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    kept = decontamination.decontaminate(df, bench).collect()
    assert [r.doc_id for r in kept] == [k for k in got if not got[k].contaminated]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(df, bench, remove="spans").collect()}
    assert cut[3] == "" and cut[2] == texts[2] and cut[5] is None
    assert decontamination.overlaps(odd, bench).count() == len(ODD) + 2
    assert decontamination.overlaps(odd, bench.where("false")).where("contaminated").count() == 0
    assert decontamination.overlaps(odd.where("false"), bench).count() == 0
    # a large benchmark goes by joins, with the same rows
    assert {tuple(r) for r in decontamination.overlaps(df, bench, at_once=2).collect()} == {tuple(r) for r in got.values()}
    for how in ("documents", "spans"):
        one, two = (sorted(map(tuple, decontamination.decontaminate(odd.union(odd), bench, remove=how, at_once=n).collect()), key=str) for n in (2, 500))
        assert one == two


def test_a_large_benchmark_gives_the_same_hits(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in decontamination.overlaps(docs, bench).collect()}
    assert {tuple(r) for r in decontamination.overlaps(docs, bench, at_once=400).collect()} == whole


@pytest.mark.parametrize("at_once", [3, 500])
def test_spans_go_at_once(spark, at_once):
    bench = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(14)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"k{i}" for i in range(14)) + " c", "x")], "doc_id long, text string, spans string")
    assert [tuple(r) for r in decontamination.decontaminate(docs, bench, remove="spans", at_once=at_once).collect()] == [(1, "a b  c", "x")]


# ---- 7


def test_telephony_tables_and_blocks():
    assert telephony.mulaw_table()[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    fast = telephony.decode_adpcm(raw)
    for row, got in zip(raw, fast):  # one sample after another
        value, index = int(np.int16(int(row[0]) | int(row[1]) << 8 if row[1] < 128 else (int(row[0]) | int(row[1]) << 8) - 65536)), min(int(row[2]), 88)
        out = [value]
        for b in row[4:].tolist():
            for code in (b & 15, b >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        assert got.tolist() == out
    tone = (10000 * np.sin(2 * np.pi * 300 * np.arange(8000) / 8000)).astype(np.int16)
    for to in (16000, 11025, 4000):
        got = telephony.resample(tone, 8000, to)
        want = 10000 * np.sin(2 * np.pi * 300 * np.arange(len(got)) / to)
        assert len(got) == 8000 * to // 8000 and np.abs(got - want)[50:-50].max() < 400


@pytest.mark.parametrize("codec", [None, "mulaw", "alaw", "adpcm"])
def test_media_round_trip(odd, codec):
    rows = telephony.decode_media(telephony.media_table(odd, codec), with_pcm=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = (ODD[r.doc_id] if r.doc_id is not None else "no id here at all") or ""
        payload = text.encode() + b"\0" * (-len(text.encode()) % 64) or b"\0" * 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert codec is None or r.feature.startswith(codec)
        assert len(r.pcm) == 2 * 2 * int(r.feature.split(":")[1]) and zlib.crc32(r.pcm) == int(r.feature.split(":")[5])


# ---- 2, 5, 10


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeinorst"), int(rng.integers(2, 9)))) for _ in range(800)]
    bad = ["blorgnut", "zwickelfax", "pumpdrool"]

    def twist(w):
        k = int(rng.integers(4))
        i = int(rng.integers(1, len(w)))
        return [w, ".".join(w), w[:i] + w[i - 1] + w[i:], w.upper()][k]

    rows, labels = [], []
    for i in range(700):
        words = list(rng.choice(plain, int(rng.integers(20, 60))))
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            words.insert(int(rng.integers(len(words))), twist(str(rng.choice(bad))))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score_toxicity(docs, model).join(marks, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in got])
    assert len(got) > 80 and right > 0.95
    kept = toxicity.drop_toxic(docs, model).count()
    assert abs(kept - 525) < 25


def test_toxicity_learns_nothing_from_held_out_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} {'bad' if i % 4 == 0 else 'good'} x{i}") for i in range(60)], "doc_id long, text string")
    weights = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, toxic, calibrate, clean_weight: weights.append(clean_weight))
    for held_out in (0, 1):
        rows = [(i, held_out if zlib.crc32(str(i).encode()) % 5 == 0 else int(i % 4 == 0)) for i in range(60)]
        toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), sample=5)
    assert weights[0] == weights[1] > 1


def test_toxicity_odd_rows(odd):
    empty = toxicity.fit([["a"], ["b"]], np.array([0, 0]), np.array([False, True]))
    rows = toxicity.score_toxicity(odd, empty).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    names, number, first = toxicity.bag_words(next(textkit.blocks(pa.array(["An i.d.i.o.t and i d i o t", "", "x y"]))))
    assert [names[i] for i in number[first[0] : first[1]]] == ["an", "idiot", "and", "idiot"]
    assert first[1] == first[2] and [names[i] for i in number[first[2] :]] == ["xy"]
    assert "".join(toxicity.pieces("w" * 20)) == "w" * 20 and all(len(p) <= 31 for p in toxicity.pieces("w" * 500))


PAGES = {
    "plain": ("<html><head><title>t</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A  title</h1><p>First &amp; best\n text.<p>Second&nbsp;one, with <b>bold</b>.</article><footer>&copy; us</footer></body></html>", "A title\n\nFirst & best text.\n\nSecond one, with bold."),
    "clutter": ('<body><div class="cookie-notice"><p>We use cookies.</p></div><header class="site-header"><p>Shop</p></header><article><h1>Head line here</h1><p>Some prose that goes on, and on, for a while.</p></article><section class="comments"><h2>Comments</h2><div class="comment"><p>Nice post, thanks!</p></div></section><aside class="sidebar"><ul><li><a href=/x>More</a></li></ul></aside></body>', "Head line here\n\nSome prose that goes on, and on, for a while."),
    "scripts": ("<article><script>var t='<p>no</p>'</script><style>p{}</style><p>Only this text is said here, really.</p><!-- <p>nor this</p> --></article>", "Only this text is said here, really."),
}


def test_main_text(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(PAGES.values())] + [(7, None, None), (8, "u", ""), (9, "u", "<<<>>> < a"), (0, "u0", PAGES["plain"][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()]
    for i, (_, want) in enumerate(PAGES.values()):
        assert (i, want, len(want)) in got
    assert (7, "", 0) in got and (8, "", 0) in got and len(got) == len(rows)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
        ("<p>one <svg><title>Icon</title><g><text>no</text></g></svg> two</p>", ["one two"]),
        ("<p>one <a href=/x><svg><path></a> two</p><div><svg><path d='m'><p>three</p></div><p>four</p>", ["one two", "three", "four"]),
        ("<svg><foreignObject><div><p>no</p></div></foreignObject><text>no</text></svg><p>one</p>", ["one"]),
        ("<p>one</p><object data=x><p>two</p><canvas>three<p>four<video src=v><p>five<audio><p>six", ["one", "two", "three", "four", "five", "six"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <math/> so</p>", ["if x=2 then so"]),
        ("<p>one</p><video-player></video-player><template><p>no</p></template><p>two</p><template><p>three</p>", ["one", "two", "three"]),
        ("<svg><svg></svg><text>no</text></svg><p>one</p>", ["one"]),
        ('<p title="a<b">x y z</p>', ["x y z"]),
        ("<p data-t='<b>hey</b>' id=it's>one</p><p>two's</p>", ["one", "two's"]),
        ('<p title="never closed>one</p><p>two</p>', ["one", "two"]),
        ("<script data-x='</script>'>no</script><p>one</p>", ["one"]),
        ("<p>one</p><script>no</script x><p>two</p><script>no", ["one", "two"]),
        ("<html><head><title>a <b>t</b></title><meta name=x><p>one</p><p>two</p></html>", ["one", "two"]),
        ("<html><head><title>t</title>one<p>two</p>", ["one", "two"]),
        ("<html><head><title>t</title><link rel=x></head><body><p>one</p></body></html>", ["one"]),
    ],
)
def test_page_reader_keeps_article_text(page, want):
    assert [t for t, _, _ in html_text.leaf_blocks(page)] == want


def test_deep_nesting_is_linear():
    import time

    for page, n in (("<div>" * 20_000, 0), ("<div>x" * 20_000, 20_000), ("<ul><li>" * 10_000 + "x", 1), ("<p>a<span>" * 20_000 + "</div>" * 20_000, 20_000)):
        began = time.process_time()
        assert len(html_text.leaf_blocks(page)) == n
        assert time.process_time() - began < 3


def test_labeller_on_unseen_layouts():
    model, maker = html_text.train(), html_text._Maker(np.random.default_rng(123))
    right = total = 0
    for _ in range(150):
        blocks, y = maker.page()
        right += (model.label([html_text.features([blocks])])[0] == y).sum()
        total += len(y)
    assert right / total > 0.97


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    m = html_text.BiLSTM(hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = html_text.pad([rng.normal(size=(4, html_text.INPUT)), rng.normal(size=(2, html_text.INPUT))])
    x, y = x.astype(np.float64), rng.integers(0, 2, mask.shape).astype(np.float64)
    _, grad = m.gradients(x, mask, y)
    for name in ("Wf", "Ub", "cf", "V"):
        at = tuple(int(rng.integers(s)) for s in m.p[name].shape)
        keep = m.p[name][at]
        loss = []
        for step in (1e-3, -1e-3):
            m.p[name][at] = keep + step
            loss.append(m.gradients(x, mask, y)[0])
        m.p[name][at] = keep
        assert math.isclose((loss[0] - loss[1]) / 2e-3, grad[name][at], rel_tol=0.05, abs_tol=2e-5)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in got]) > 0.9


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200)
    text, meta = ((y[:, None] * 2 - 1) * 1.5 + rng.normal(size=(1200, 4)) for _ in range(2))
    label = np.where(np.arange(1200) < 60, y, -1)
    model = quality.co_train(text.astype(np.float32), meta.astype(np.float32), label, np.arange(1200) < 15)
    assert ((model.scores(text, meta) > 0.5) == y).mean() > 0.97


def test_quality_odd_rows(spark, odd):
    model = quality.co_train(np.zeros((2, quality.TEXT_SIZE), np.float32), np.zeros((2, quality.META_SIZE), np.float32), np.array([1, 1]), np.array([False, True]))
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(odd.select("doc_id", "text"), model).count() == len(ODD) + 2


# ---- the pipeline


def brute_cuts(texts):
    """What is left of each text, in words, when every word of a window of 20 that stands earlier goes."""
    seen, out = set(), {}
    for k in sorted(texts):
        block = next(textkit.blocks(pa.array([texts[k] or ""])))
        starts, ends, _, _ = substrings.pieces(block)
        words = [block.data[a:b].tobytes() for a, b in zip(starts, ends)]
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            gone |= set(range(i, i + 20)) if window in seen else set()
            seen.add(window)
        if not words or len(gone) < len(words):
            raw, at, kept = texts[k].encode(), 0, []
            for i in sorted(gone):
                kept.append(raw[at : starts[i]] if i - 1 not in gone else b"")
                at = int(ends[i])
            out[k] = (b"".join(kept) + raw[at:]).decode().split()
    return out


def test_empty_tables(spark, docs, odd):
    none, labels = odd.where("false"), spark.read.parquet(f"{SF}/labels.parquet")
    for column in ("toxic", "quality"):
        fitted = (toxicity if column == "toxic" else quality).train(none, labels.where("false"))
        rows = (toxicity.score_toxicity if column == "toxic" else quality.score_quality)(odd, fitted).collect()
        assert len(rows) == len(ODD) + 2 and len({round(r.score, 9) for r in rows}) >= 1
    empty = [
        toxicity.score_toxicity(none, fitted_toxic(spark)), frames.read_frames(frames.write_frames(none, PATH)), token_counts.token_counts(none, PATH), packing.pack_powers_of_two(none, PATH),
        telephony.decode_media(telephony.media_table(none), with_pcm=True), decontamination.overlaps(none, spark.read.parquet(f"{SF}/benchmark.parquet")),
        html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")), near_copies.near_copies(none), substrings.drop_repeats(none),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def fitted_toxic(spark):
    return toxicity.fit([["a"], ["b"]], np.array([0, 0]), np.array([False, True]))


def test_frames_of_wanted_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(0, 200, 2)], "doc_id long, text string")
    manifest = frames.write_frames(docs, PATH, f"file://{tmp_path}/f", frame_ids=64, files=7)
    every = {r.doc_id: tuple(r) for r in frames.read_frames(manifest).collect()}
    wanted = spark.createDataFrame([(0,), (0,), (7,), (50,), (198,), (-3,), (999,), (None,)], "doc_id long")
    assert {tuple(r) for r in frames.read_frames(manifest, wanted=wanted).collect()} == {every[k] for k in (0, 50, 198)}


def test_sequences_of_a_bucket_follow_one_another(spark, docs, tmp_path):
    rows = packing.pack_powers_of_two(docs, PATH, longest=256)
    ids = sorted((r.sequence_id, r.length) for r in rows.collect())
    assert [k for k, _ in ids] == list(range(len(ids))) and [n for _, n in ids] == sorted((n for _, n in ids), reverse=True)
    packing.write_buckets(rows, str(tmp_path / "b"), files=2)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == len(ids) and back.where("length = 256").count() == sum(n == 256 for _, n in ids)


def test_pool_sums_are_those_of_arrays(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    views = [next(quality._views(pa.array([r.text]), pa.array([r.lang]), pa.array([r.source]), pa.array([float(r.n_chars)]))) for r in docs.collect()]
    text, meta = (np.concatenate([v[k] for v in views]).astype(np.float16).astype(np.float32) for k in (1, 2))
    rng = np.random.default_rng(0)
    fitted = [rng.normal(size=x.shape[1] + 1) * 3 for x in (text, meta)]
    ids = docs.select("doc_id").toPandas()["doc_id"].to_numpy()
    table = spark.createDataFrame([(int(i), bytearray(a.astype(np.float16).tobytes()), bytearray(b.astype(np.float16).tobytes())) for i, a, b in zip(ids, text, meta)], quality._ROW).repartition(3)
    for left_out in ([], ids[:20]):
        keep = ~np.isin(ids, left_out)
        one, two = quality.TablePool(table, np.array(left_out, np.int64)), quality.ArrayPool(text[keep], meta[keep])
        assert (one.counts(fitted) == two.counts(fitted)).all()
        cuts = [quality._sure(c, 0.2 * keep.sum(), 0.7) for c in two.counts(fitted)]
        for (n, a), (m, b) in zip(one.sums(fitted, cuts), two.sums(fitted, cuts)):
            assert n == m and np.allclose(a, b)


def test_labels_that_disagree_are_not_learnt_from(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    torn = labels.unionByName(labels.select("doc_id", (1 - F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic")))
    assert np.ptp(toxicity.train(docs, torn).weight) == 0
    assert not quality.train(docs, torn).text.any()


def test_toxic_margins_count():
    model = toxicity.Model(np.zeros(1, np.float32), 0.0, (-2.0, 0.5, 0.2, 3.0))
    seen = toxicity.summed(np.array([-1.0, 0.5, 0.25, -2.0]), np.array([0, 2, 2, 4]))
    assert seen.tolist() == [[0.5, -1.0, 1.0], [toxicity.NOTHING] * 2 + [0.0], [0.25, -2.0, 0.5]]
    scores = model.scores(seen)
    assert scores[1] < scores[2] < scores[0]


def test_pipeline_stages_take_effect(spark, docs, odd, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, now, SF), "t")
        if name == "n-gram Jaccard join":
            low = brute_components(brute_sets({r.doc_id: r.text for r in now.collect()}, 5), 80)
            assert {r.doc_id for r in out.collect()} == {k for k, v in low.items() if k == v}
        if name == "toxicity":  # one document at a time
            model = toxicity.train(now, spark.read.parquet(f"{SF}/labels.parquet"))
            score = lambda t: model.scores(toxicity.Scorer(model).look(next(textkit.blocks(pa.array([t or ""])))))[0]
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect() if score(r.text) < 0.5}
        if name == "substring dedup":
            assert {r.doc_id: r.text.split() for r in out.collect()} == brute_cuts({r.doc_id: r.text for r in now.collect()})
        if name == "benchmark decontamination":
            bad = decontamination.overlaps(now, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()} - {r.doc_id for r in bad.collect()}
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()}
            assert out.agg(F.sum("length")).first()[0] == sum(len(ids_of(r.text)) for r in now.collect())
        else:
            assert out.columns == columns and out.count() <= now.count()
        now = out
    assert now.count() > 0
