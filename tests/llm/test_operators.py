"""Each corpus operator against brute force, held-out rows, round trips and nasty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import best_fit_packing, common, exact_dedup, fingerprint, language_id, line_dedup, minhash, quality, sentencepiece_codec, sharding, toxicity
from driftwell.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")

CLASHES = ["did", "th", "rank", "level", "gone", "row", "node", "_did", "_text", "left", "score", "shard", "one", "n", "key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *[7] * len(CLASHES)) for i, t, lang in rows], SCHEMA)


def nasty():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "εψιλον", "数", "Idiot", "you"]
    line = " ".join(rng.choice(words) for _ in range(30))
    long = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(400))
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "x", None), (5, "123 456", "en"), (6, line, "en"), (7, line, "fr")]
    rows += [(8, line.replace(" ", "  "), "en"), (8, line, "en"), (8, line, "en"), (None, line, "en"), (None, "other text", None)]
    rows += [(9, long, "en"), (10, long + " tail", "de"), (11, "a" * 50_000, "en"), (12, line + "\n" + long[:3000], "en"), (-5, "é😀" * 10, "en")]
    rows += [(13, "a <|endoftext|> b<|endoftext|>\n\nc", "en"), (14, "x" + " " * 60_000 + "y", "en")]
    return rows


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (6, 1, 1), (6, 0, 0), (9, 1, 0), (None, 1, 1), (99, 0, 1), (12, 0, 1)], LABELS)


RUNS = {
    "language": lambda s, d: language_id.identify(d, language_id.fit(d)),
    "lines": lambda s, d: line_dedup.line_dedup(d),
    "packing": lambda s, d: best_fit_packing.pack(d, best_fit_packing.default_tokenizer()),
    "pieces": lambda s, d: sentencepiece_codec.encode(d, sentencepiece_codec.default_model()),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "shards": lambda s, d: sharding.hilbert_shards(d),
    "quality": lambda s, d: quality.scored(d, quality.fit(d, labels(s))),
    "toxicity": lambda s, d: toxicity.scored(d, toxicity.fit(d, labels(s))),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_nasty_and_empty_tables(spark, name):
    docs = frame(spark, nasty())
    got = RUNS[name](spark, docs).collect()
    ids = Counter(r.doc_id for r in got)
    if name == "packing":
        assert set(ids) == {i for i, _, _ in nasty()}
    else:
        assert ids == Counter(i for i, _, _ in nasty())
    assert RUNS[name](spark, docs.where("false")).collect() == []


def test_exact_dedup_against_brute_force(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in nasty():
        groups[norm(t)].append(i)
    for block in (4, 4096):  # a tiny block makes many levels
        got = exact_dedup.exact_dedup(frame(spark, nasty()), block).collect()
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        want = {hashlib.sha256(t.encode()).hexdigest(): (min([i for i in g if i is not None], default=None), len(g)) for t, g in groups.items()}
        assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in got)


def test_shared_digests_do_not_merge_blocks(spark, monkeypatch):
    blocks = exact_dedup._blocks
    monkeypatch.setattr(exact_dedup, "_blocks", lambda d, b: blocks(d, b).withColumn("digest", F.lit(1).cast("long")))
    rows = [(1, "one", None), (2, "two", None), (3, "one", None)]
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()} == {(1, 1), (2, 2), (3, 1)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(words))
    return frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if words else frozenset()


@pytest.mark.parametrize("group", [256, 8])
def test_near_duplicates_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", group)  # small groups make many salted stars and blocks
    rng = random.Random(3)
    base = [[f"w{rng.randrange(2000)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        rows.append((i * 3, " ".join(words), "en"))
    rows += [(1000, "Few words", None), (1001, "few WORDS", None), (1002, "", None), (1003, None, None)]
    sets = {i: shingle_set(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= 85 * union and find(a) != find(b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = minhash.near_duplicates(frame(spark, rows), 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_wide_buckets_are_searched_by_prefixes(spark, monkeypatch):
    used = []
    prefixes = minhash._prefixes
    monkeypatch.setattr(minhash, "_prefixes", lambda mine, percent: used.append(1) or prefixes(mine, percent))
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    sets = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(150)] = f"n{rng.randrange(9999)}"
        sets.append(np.unique(np.array([hash(x) & (2**63 - 1) for x in zip(words, words[1:], strict=False)], dtype=np.uint64)))
    mine = spark.createDataFrame([(i, i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, root long, items binary")
    held = defaultdict(set)
    for r in minhash._prefixes(mine, 90).collect():
        held[r.key].add(r.node)
    for a, b in combinations(range(60), 2):
        if minhash.similar(sets[a], sets[b], 90):
            assert any({a, b} <= nodes for nodes in held.values())
    member = mine.select(F.lit(1).cast("long").alias("key"), "node", "root", F.lit(140).cast("long").alias("n"))
    roots = mine.select("node", "root")
    plain = minhash._block_links(member.select("key", "node", "n"), roots, mine.select("node", "items"), 90)
    monkeypatch.setattr(minhash, "GROUP", 7)
    wide = minhash._block_links(member.select("key", "node", "n"), roots, mine.select("node", "items"), 90)
    parts = []
    for links in (plain, wide):
        parts.append(sorted(map(tuple, connected_components(links).collect())))
    assert parts[0] == parts[1] and parts[0] and used


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_components_of_a_million_links(spark):
    edges = spark.range(1_000_000).selectExpr("2 * id AS u", "2 * id + 1 AS v")
    got = connected_components(edges)
    assert got.count() == 2_000_000 and got.where("root <> node - node % 2").count() == 0


def test_patience_blocks():
    assert line_dedup.patience_blocks([(0, 0, 1), (1, 1, 1), (2, 5, 2)]) == [[(0, 0, 2), (2, 5, 2)]]
    # Crossing anchors are aligned in turn, and each anchor is in one alignment.
    assert line_dedup.patience_blocks([(0, 2, 1), (1, 0, 1), (2, 1, 1)]) == [[(1, 0, 2)], [(0, 2, 1)]]
    assert line_dedup.patience_blocks([]) == []
    rng = random.Random(2)
    for _ in range(200):
        anchors = [(rng.randrange(9), rng.randrange(9), 1) for _ in range(rng.randrange(12))]
        chains = line_dedup.patience_blocks(anchors)
        assert all(x[0] < y[0] and x[1] < y[1] for c in chains for x, y in zip(c, c[1:]))
        assert Counter((a + k, b + k) for c in chains for a, b, n in c for k in range(n)) == Counter((a, b) for a, b, _ in set(anchors))


def lines_lost(rows, least=10):
    """By definition, over all pairs: lines in runs of ``least`` words that an earlier document has, and blank lines between them."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        whole = [x.strip(" ") for x in t.split("\n")]
        full = [j for j, x in enumerate(whole) if x]
        runs = {(a, b): tuple(whole[j] for j in full[a:b]) for a in range(len(full)) for b in range(a + 1, len(full) + 1)}
        gone = {k for (a, b), run in runs.items() if run in seen and sum(len(x.split()) for x in run) >= least for k in range(a, b)}
        seen.update(runs.values())
        lost = {full[k] for k in gone}
        for k in gone:
            if k + 1 in gone:
                lost.update(range(full[k], full[k + 1]))
        out[i] = sorted(lost)
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 8))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(["", "  ", *pool, *pool]) for _ in range(rng.randrange(0, 16)))) for i in range(80)]
    # A boilerplate line with the earliest holder 1 does not keep 9 from meeting 5.
    hot = "this line is everywhere"
    rows += [(101, hot), (105, f"alpha beta gamma\n{hot}\ndelta epsilon zeta"), (109, f"x\nalpha beta gamma\n{hot}\ndelta epsilon zeta")]
    want = lines_lost(rows)
    assert want[109] == [1, 2, 3] and sum(map(len, want.values())) > 90
    got = line_dedup.line_dedup(frame(spark, [(i, t, "en") for i, t in rows])).collect()
    assert {r.doc_id: r.lines_removed for r in got} == want
    assert all(r.text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i]) for r in got for i, t in rows if r.doc_id == i)
    assert all(r[c] == 7 for r in got for c in CLASHES)


def test_many_equal_lines(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "\n".join([line] * 100_000), "en"), (2, "\n".join([line] * 100_000), "en"), (3, f"x\n{line}", "en")]
    got = line_dedup.line_dedup(frame(spark, rows)).select("doc_id", F.size("lines_removed").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 0, 2: 100_000, 3: 1}


def test_runs_of_lines_pair_documents(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    short = "\n".join(f"v{i} w{i} x{i}" for i in range(4))
    rows = [(1, a, "en"), (2, b, "en"), (3, f"{a}\n{b}\nthird", "en"), (4, f"fourth\n{a}\n{b}", "en"), (5, f"{short}\nfifth", "en"), (6, f"sixth\n\n{short}", "en")]
    got = {r.doc_id: r.lines_removed for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [1, 2], 5: [], 6: [2, 3, 4, 5]}


def test_line_dedup_deletes_from_the_later(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"first line of one here\n{shared}\nend", "en"), (2, f"two starts otherwise now\n  {shared}\nbye", "en"), (3, "all alone in this world", "en"), (4, shared, "en")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text == ""
    assert got[2].text == "two starts otherwise now\nbye" and got[2].lines_removed == [1]
    left = line_dedup.without_repeats(frame(spark, rows))
    assert {r.doc_id: r.n_chars for r in left.collect()} == {1: len(rows[0][1]), 2: 28, 3: 23} and left.columns == SCHEMA.replace(",", "").split()[::2]


def test_plan_uses_every_piece_and_is_tight():
    rng = random.Random(1)
    for counts in ({1024: 3}, {1: 5000}, {1023: 10, 1: 4}, {700: 5, 324: 5, 600: 3, 212: 6}, {n: rng.randrange(1, 50) for n in rng.sample(range(1, 1025), 300)}, {512: 7}, {}):
        patterns = best_fit_packing.plan(counts)
        used = Counter()
        for p, n in patterns:
            assert sum(p) <= 1024 and n > 0
            for x in p:
                used[x] += n
        assert used == Counter(counts)
        total = sum(n for _, n in patterns)
        least = -(-sum(k * v for k, v in counts.items()) // 1024)
        # Neither the filled volume nor the pieces over half a sequence can be undercut.
        assert total <= 1.005 * max(least, sum(v for k, v in counts.items() if k > 512)) + 1
    assert sum(n for _, n in best_fit_packing.plan({700: 5, 324: 5, 600: 3, 212: 6})) == 8


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*nasty(), (20, " " * 1_000_000, "en"), (21, "ab!c" * 250_000, "en"), (22, "z" + "\n" * 70_000 + "<|endoftext|>", "en")]
    got = best_fit_packing.pack(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine, at = len(ids) % 1024 or 1024, 0
        for k in range(-(-len(ids) // 1024)):
            want.append((i, k, at, mine - at, crc32(ids[at:mine].tobytes())))
            at, mine = mine, mine + 1024
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_keeps_added_tokens_whole(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext |> <|endoftext|", "  <|endoftext|>  z"]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in best_fit_packing.pack(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), path).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (len(ids), crc32(ids.tobytes()))


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["", " ", " x", "x ", "  a  b\n\n c\t", "ﬁ ½ 　 日本語 😀", "a" * 500, "def f(x):\n    return x", "\x01 \x00", *[t or "" for _, t, _ in nasty()]]
    codec = sentencepiece_codec.Codec(model)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text) and codec.decode(ids.tolist()) == text
    docs = frame(spark, nasty())
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    assert Counter(r.text for r in back.collect()) == Counter(t or "" for _, t, _ in nasty())
    assert codec.decode(library.encode("a▁b")) == "a b"


def unigram_model(path, pieces):
    """A unigram model file written by hand: nothing is trained."""
    import struct

    def field(number, kind, payload):
        size = b"" if kind != 2 else varint(len(payload))
        return varint(number << 3 | kind) + size + payload

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    raw = b""
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, x, 1) for p, x in pieces]]:
        raw += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, varint(kind)))
    raw += field(2, 2, field(3, 0, varint(1)))  # the trainer's kind of model: unigram
    raw += field(3, 2, field(1, 2, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(0)) + field(5, 0, varint(1)))
    path.write_bytes(raw)
    return str(path)


def test_unigram_models_take_the_best_path(tmp_path):
    import sentencepiece

    rng = random.Random(6)
    pieces = {"▁": -4.5, **{c: -5.0 - i / 7 for i, c in enumerate("abcdefgh")}}
    while len(pieces) < 120:
        pieces.setdefault(rng.choice(["", "▁"]) + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))), -rng.uniform(2, 12))
    model = unigram_model(tmp_path / "unigram.model", list(pieces.items()))
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    codec = sentencepiece_codec.Codec(model)
    assert not codec.bpe
    texts = [" ".join("".join(rng.choice("abcdefghx") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
    with pytest.raises(ValueError, match="across words"):
        sentencepiece_codec.Codec(unigram_model(tmp_path / "wide.model", [("a▁b", -1.0)]))


def test_hilbert_curve_visits_neighbours(spark):
    bits = 3
    cells = spark.range(1 << (3 * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit(7)).alias(f"d{i}") for i in range(3)])
    out = cells
    for name, column in sharding.hilbert_index([F.col(f"d{i}") for i in range(3)], bits):
        out = out.withColumn(name, column)
    path = [(r.d0, r.d1, r.d2) for r in out.orderBy("curve").collect()]
    assert sorted(r.curve for r in out.collect()) == list(range(1 << (3 * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:]))


def test_shards_are_even_and_gapless(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i % 7}" * (i % 5), ["en", "fr"][i % 2]) for i in range(101)])
    got = sharding.hilbert_shards(docs, 24).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert {len(v) for v in by.values()} == {4, 5} and all(sorted(v) == list(range(len(v))) for v in by.values())
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == crc32(texts[r.doc_id].encode()) and r.law == "rows" for r in got)
    tied = sharding.hilbert_shards(frame(spark, [(5, "same", "en")] * 50), 24).collect()
    assert sorted(Counter(r.shard for r in tied).values()) == [2] * 22 + [3] * 2 and len({(r.shard, r.slot) for r in tied}) == 50
    zones = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 101 and zones.count() == 4


def test_sizes_have_levels_of_their_own(spark):
    docs = frame(spark, [(i, "x" * 4**i, "en") for i in range(1, 11)])
    assert len({r.d_size for r in sharding.hilbert_shards(docs, 2).collect()}) >= 8


def test_entropy_and_likeness():
    data = np.random.default_rng(1).integers(97, 105, 300).astype(np.uint8)
    w = fingerprint.WINDOW
    want = [-sum(c / w * np.log2(c / w) for c in Counter(data[i : i + w].tolist()).values()) for i in range(300 - w + 1)]
    assert np.abs(fingerprint.entropy_levels(data) - np.array(want) / 0.05).max() <= 1.01
    rank = np.arange(fingerprint.LEVELS)
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)).encode()
    a, b = text(800), text(800)
    x, y, z = (fingerprint.Digest.of(fingerprint.features(t, rank)) for t in (a, b, a[: len(a) * 2 // 3] + b[: len(a) // 3]))
    assert fingerprint.likeness(x, x) == 1.0 and fingerprint.likeness(x, y) < 0.1 < 0.4 < fingerprint.likeness(x, z)
    assert fingerprint.Digest.parse(x.text()).text() == x.text() and fingerprint.Digest.parse("").text() == ""


@pytest.mark.parametrize("n", [3, 8, 15, 19, 23, 130, 150, 191, 220, 370])
def test_likeness_where_windows_change(n):
    rank = np.arange(fingerprint.LEVELS)
    rng = random.Random(n)
    plain = "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(n))
    digest = lambda t: fingerprint.Digest.of(fingerprint.features(t.encode(), rank))
    for other in ("éèüößñ", "数学文字"):
        new = fingerprint.edited(plain, "".join(rng.choice(other) for _ in range(n)))
        assert fingerprint.likeness(digest(plain), digest(new)) > 0.2
        assert fingerprint.likeness(digest(new), digest(plain)) > 0.2


def test_fingerprints_follow_descending_ids(spark):
    rows = [(i, f"document number {i} " * (i % 9), "en") for i in range(0, 300, 3)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = fingerprint.edited(t, after)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def corpus(seed, n=300):
    rng = random.Random(seed)
    tongue = {"en": ["the", "ing", "th", "er"], "fr": ["eau", "les", "è", "oui"], "de": ["sch", "ung", "ein", "ö"]}
    rows, marks = [], []
    for i in range(n):
        lang = rng.choice(list(tongue))
        words = ["".join(rng.choice(tongue[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 90))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["grubbo", "snarfel", "idiot"])
        if poor:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        rows.append((i, " ".join(words) + ".", lang))
        marks.append((i, int(not poor), int(toxic)))
    return rows, marks


def test_models_on_held_out_rows(spark):
    rows, marks = corpus(11)
    docs, known = frame(spark, rows), spark.createDataFrame(marks, LABELS)
    langs = {i: x for i, _, x in rows}
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.lang_pred == langs[r.doc_id] for r in got)
    for module, at in ((quality, 1), (toxicity, 2)):
        truth = {m[0]: m[at] for m in marks}
        out = module.scored(docs, module.fit(docs, known)).collect()
        held = [r for r in out if r.held_out]
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
        left = module.accepted(docs, module.fit(docs, known))
        assert left.columns == docs.columns and left.count() == sum(r.predicted == (1 if at == 1 else 0) for r in out)


def weigh(text, lexicon):
    return [toxicity.clause_weight(c, lexicon) for c in toxicity.clauses(text.lower())]


def test_clauses_match_by_pattern():
    lexicon = toxicity.Lexicon({"grubbo": 4.0}, {})
    assert weigh("grubbo", lexicon) == [0.0] and weigh('"grubbo"', lexicon) == [0.0]  # a lone word is no clause
    assert weigh("a grubbo", lexicon) == weigh("grubbo text", lexicon) == [4.0]
    assert weigh("you grubbo", lexicon) == weigh("grubbo you", lexicon) == [4.8]
    assert weigh("not a grubbo", lexicon) == weigh("it said a grubbo", lexicon) == [2.0] and weigh("they said not a grubbo", lexicon) == [1.2]
    assert weigh("grubbo one two three four five six you", lexicon) == [4.0]


def test_threats_and_reported_speech():
    lexicon = toxicity.Lexicon({"grubbo": 4.0}, {})
    assert weigh("I will kill you", lexicon) == weigh("you I will kill", lexicon) == [1.2]
    assert weigh("kill the time", lexicon) == [0.0] and weigh("I will kill. You", lexicon) == [0.0, 0.0]
    assert toxicity.evidence("I will kill you.", lexicon)[0] == 1.2
    assert weigh("it said: a grubbo", lexicon) == [2.0] and weigh("note: you grubbo", lexicon) == [0.0, 4.8]
    assert weigh('it said: "go. one two three four five six seven eight nine. grubbo" and grubbo', lexicon) == [6.0]
    assert weigh('it said "go\na grubbo', lexicon) == [0.0, 4.0]


def test_words_of_several_kinds_take_the_best_path():
    lexicon = toxicity.Lexicon({"kill": 5.0, "grubbo": 4.0, "zorks": 1.0, "mord": 3.0}, {"gru": 2.0}, {"zorks": "target", "mord": "threat"})
    assert dict(lexicon.read("kill")) == {"insult": 5.0, "threat": 1.0} and dict(lexicon.read("grubbel")) == {"insult": 2.0}
    assert weigh("kill the time", lexicon) == [5.0] and weigh("kill you", lexicon) == [6.0]
    assert weigh("mord the time", lexicon) == [0.0] and weigh("mord the zorks", lexicon) == [pytest.approx(3.6)]

    def brute(readings):
        """Every reading and every way through the transducers, one after the other."""
        best = 0.0

        def walk(i, states, total):
            nonlocal best
            if i == len(readings):
                if not states[2][1] and states[3] != 2:
                    best = max(best, total)
                return
            for symbol, weight in readings[i]:
                for a, out1, f1 in toxicity.negation(states[0], symbol):
                    for b, out2, f2 in toxicity.reported(states[1], out1):
                        for c, out3, f3 in toxicity.target(states[2], out2):
                            for d, out4, f4 in toxicity.insult(states[3], out3):
                                walk(i + 1, (a, b, c, d), total + (weight * f1 * f2 * f3 * f4 if out4 == "hit" else 0))

        walk(0, (0, 0, (0, 0), 0), 0.0)
        return best

    rng = random.Random(9)
    for _ in range(150):
        words = [rng.choice(["you", "not", "said", '"', "a", "b", "c", "d", "kill", "grubbo", "mord", "zorks", "idiot"]) for _ in range(rng.randrange(1, 9))]
        assert toxicity.clause_weight(words, lexicon) == pytest.approx(brute([lexicon.read(w) for w in words]))


def test_learned_arcs_have_kinds():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    texts, y = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 2:
            words[10:12] = ["mordo", "you"]
            words[20:22] = ["idiot", "xenkels"]
            words[5] = "grubbo"
        texts.append(" ".join(words))
        y.append(i % 2)
    lexicon = toxicity.Lexicon.learn(toxicity.Sample(texts, np.array(y)), np.ones(400, dtype=bool))
    assert {"mordo", "xenkels", "grubbo"} <= set(lexicon.words)
    assert lexicon.kinds.get("mordo") == "threat" and lexicon.kinds.get("xenkels") == "target" and "grubbo" not in lexicon.kinds


def test_undetermined_language(spark):
    rows, _ = corpus(3, 60)
    got = {r.doc_id: r for r in language_id.identify(frame(spark, [(500, None, None), (501, "12 34 ²", "en"), (502, "", "fr"), *rows]), language_id.fit(frame(spark, rows))).collect()}
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"} and {got[i].score for i in (500, 501, 502)} == {0.0}


def test_samples_are_drawn_row_by_row(spark):
    texts = ["the ing th er " * 8 + f"{i}" for i in range(300)]
    # Half of the labels belong to no document, one id has 20,000 rows, and many texts are null.
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(11, f"eau les oui {i}", "fr") for i in range(20_000)] + [(i, None, "de") for i in range(400, 2000)]
    docs = frame(spark, rows).repartition(4).cache()
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(100_000)], LABELS)
    sample, sizes = common.labelled_sample(docs, known, "quality", folds=3, held_out=1, per_class=80, max_bytes=1 << 20)
    usable = [r for r in rows if r[1] is not None and crc32(str(r[0]).encode()) % 3 != 1]
    assert sizes == Counter(r[0] % 2 for r in usable) and Counter(y for _, y in sample) == {0: 80, 1: 80}
    assert len(set(sample)) == 160 and sum(len(t) for t, _ in common.labelled_sample(docs, known, "quality", folds=3, held_out=1, per_class=80, max_bytes=2000)[0]) <= 2000
    model = language_id.fit(docs)
    assert set(model.languages) == ({"en", "fr"} if crc32(b"11") % 5 else {"en"})
    docs.unpersist()


def test_scores_equal_the_kernel():
    """Ridge over explicit kernels of whole n-gram sets, without the folding of matrices that the model does."""
    rows, _ = corpus(5, 60)
    texts, langs = [t for _, t, _ in rows], [x for _, _, x in rows]
    model = language_id.Model.fit(texts, langs)
    sets = [[set(p.tolist()) for p in language_id.presence(t)] for t in texts]
    kernel = np.array([[sum(len(a[k] & b[k]) / np.sqrt(max(len(a[k]), 1) * max(len(b[k]), 1)) for k in range(3)) / 3 for b in sets] for a in sets])
    y = np.array([model.languages.index(x) for x in langs])
    picked = np.concatenate([np.flatnonzero(y == c)[: language_id.LANDMARKS // len(model.languages)] for c in range(len(model.languages))])
    values, vectors = np.linalg.eigh(kernel[np.ix_(picked, picked)])
    sound = values > 1e-6 * values.max()
    mapped = kernel[:, picked] @ (vectors[:, sound] / np.sqrt(values[sound]))
    w = 1 / np.bincount(y)[y]
    goal = np.where(y[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    want = mapped @ np.linalg.solve((mapped * w[:, None]).T @ mapped + language_id.RIDGE * np.eye(mapped.shape[1]), (mapped * w[:, None]).T @ goal)
    assert np.abs(model.scores(texts) - want).max() < 1e-3


def test_quality_threshold_is_a_quantile():
    rows, marks = corpus(2, 200)
    y = np.array([m[1] for m in marks])
    model = quality.Model.fit([t for _, t, _ in rows], y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    score = model.score(np.array([quality.features(t) for _, t, _ in rows]))
    assert abs((score < 0.5).mean() - (y == 0).mean()) < 0.02
    # Pairs are ranked as labelled, and the weights are where the loss of the pairs is least along every axis.
    good, bad = score[y == 1], score[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.99


def test_quality_learns_from_all_pairs_of_all_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["one", "Two.", "3", "four!", "five,six"][i % 2 :]) for _ in range(rng.randrange(1, 12))), "en") for i in range(7000)]
    learned = [(t, i % 2) for i, t, _ in rows if crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([quality.features(t) for t, _ in learned]), np.array([v for _, v in learned])
    assert min(Counter(y.tolist()).values()) > 2100
    model = quality.fit(frame(spark, rows).repartition(3), spark.createDataFrame([(i, i % 2, 0) for i in range(9000)], LABELS))
    here = quality.Model.fit([t for t, _ in learned], y, dict(Counter(y.tolist())))
    assert np.allclose(model.weights, here.weights, atol=1e-7) and np.isclose(model.middle, here.middle, atol=1e-6)
    z = quality._expand((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3))
    good, bad = z[y == 1], z[y == 0]
    loses = 1 / (1 + np.exp((good @ model.weights)[:, None] - (bad @ model.weights)[None, :]))
    gradient = quality.RIDGE * model.weights - (loses.sum(axis=1) @ good - loses.sum(axis=0) @ bad) / loses.size
    assert np.abs(gradient).max() < 1e-5  # the loss over all pairs is least here
    strengths = z @ model.weights  # some texts are equal
    assert (strengths < model.middle - 1e-6).sum() <= len(bad) <= (strengths < model.middle + 1e-6).sum()


def test_selected_windows_against_brute_force():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 110, 400).astype(np.uint8)
    rank = rng.permutation(fingerprint.LEVELS)
    w, reach = fingerprint.WINDOW, fingerprint.REACH
    levels, hashes = fingerprint.entropy_levels(data), fingerprint.window_hashes(data, w)
    key = [(int(rank[lv]), int(h) >> 16) for lv, h in zip(levels, hashes, strict=True)]
    want = [int(hashes[i]) for i in range(len(key)) if key[i] == min(key[max(0, i - reach) : i + reach + 1])]
    assert fingerprint.features(data.tobytes(), rank).tolist() == list(dict.fromkeys(want))


def test_fingerprints_of_shared_ids(spark):
    rows = [(None, f"text {i} " * 5, "en") for i in range(40)] + [(3, "one text " * 9, "en")] * 5 + [(7, "alone " * 30, "en")]
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t, _ in rows)
    single = fingerprint.fingerprints(frame(spark, rows[-1:])).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(("alone " * 20 + "alone " * 10).encode()).hexdigest()


def test_near_duplicates_under_hot_ids_and_buckets(spark):
    rng = random.Random(7)
    # 2000 null ids: half with texts of their own, half copies of one; and a template that shares buckets but no links.
    rows = [(None, " ".join(f"v{rng.randrange(10**6)}" for _ in range(12)), "en") for _ in range(1000)] + [(None, "one text that is here many times over", "en")] * 1000
    base = [f"t{i}" for i in range(240)]
    for i in range(300):
        words = list(base)
        for k in range(0, 240, 20):
            words[k] = f"u{i}x{k}"
        rows.append((i, " ".join(words), "en"))
    rows += [(1000 + i, " ".join(base[:100] + [f"q{i % 2}x{k}" for k in range(60)]), "en") for i in range(10)]
    docs = frame(spark, rows)
    got = minhash.near_duplicates(docs, 85).collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 300} == set(range(300))
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None and r.doc_id >= 1000} == {(1000 + i, 1000 + i % 2) for i in range(10)}
    keyed = minhash._keyed(docs)
    own = minhash._signatures(docs).select("did", "th").distinct().withColumn("node", F.monotonically_increasing_id())
    assert minhash._sets(keyed, own).count() == len(rows)  # one row for each row: no row meets another's set
    left = minhash.one_of_each(docs, 85)
    assert left.columns == docs.columns and left.count() == 1001 + 300 + 2
    assert left.where(" OR ".join(f"{c} <> 7" for c in CLASHES)).count() == 0
