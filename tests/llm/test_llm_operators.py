"""Each operator against brute force, on made rows with odd cases and on a small table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import decontam, langid, licenses, line_dedup, ngram_join, packing, pii, quality, urls, warc
from graphlens.llm.common import Scratch, table
from graphlens.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rank long"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; more columns that clash with inner names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, base, "en", "a", 10, "x", 1), (2, base, "en", "a", 10, None, None), (2, base, "en", "a", 10, None, None), (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "x", 1), (None, base, "de", None, 3, "x", 1), (None, None, None, None, None, None, None), (5, base.upper(), "en", "b", 1, "x", 1),
        (6, "a@b.co ., a@b.c._x@y.zz 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999", "en", "b", 1, "x", 1),
        (7, long, "en", "b", len(long), "x", 1), (8, "  \n\n \t ", "en", "b", 1, "x", 1), (9, "🙂 é@x.y z@q-1.io password=b7db7aa4a5fcc78305", "fr", "b", 1, "x", 1),
        (10, base + "\n" + base.replace("gamma", "gammo") + "\nshort line", "en", "a", 1, "x", 1), (11, "one two", "en", None, 1, "x", 1), (12, "one two", "en", None, 1, "x", 1),
        (13, "+" * 3000 + "1" * 3000 + "." * 50 + "a" * 5000, "en", "b", 1, "x", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(rows, expected):
    assert Counter(map(tuple, rows)) == Counter(map(tuple, expected))


# --- op1


def base_spans(text):
    text, found = text or "", []
    found += [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_pii(name, request):
    df = request.getfixturevalue(name)
    rows = pii.digest(df).collect()
    expected = []
    for key, text in texts(df):
        spans = base_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        expected.append((key, *[sum(x[0] == k for x in spans) for k in pii.KINDS[:4]], hashlib.sha256(joined.encode()).hexdigest()))
    same([r[:6] for r in rows], expected)
    wanted = {e[0]: e for e in expected}
    for r in rows:
        if r["doc_id"] is not None:
            listed = [x for x in r["spans"].split(",") if x]
            assert len(listed) == sum(wanted[r["doc_id"]][1:5]) + r["n_extra"]


def test_pii_adds_secrets(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    found = {r["doc_id"]: r["spans"] for r in pii.digest(documents).collect()}
    secrets = [(k, m.span(1)) for k, t in texts(documents) for m in re.finditer(r'(?:password=|token = ")([0-9a-f]{16,40})', t or "")]
    assert secrets and sum(f"secret:{s}:{e}" in found[k] for k, (s, e) in secrets) >= 0.9 * len(secrets)


def test_pii_long_runs_of_matches(spark):
    text = " ".join(f"{i % 250}.1.2.3" for i in range(2000))
    row = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_ip"] == 2000 and row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


# --- op2


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_packing(name, request):
    df, tok = request.getfixturevalue(name), tokenizer()
    rows = packing.pack(df).collect()
    expected = []
    for key, text in texts(df):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first, start, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while start < len(ids):
            part = ids[start : first if not k else start + 2048]
            expected.append((key, k, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
            start, k = start + len(part), k + 1
    same([r[:5] for r in rows], expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_words_encode_like_whole_texts():
    tok, words = tokenizer(), packing.Encoder("byte_bpe_50k.json")
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "a", "Ünder", "don't", "12", "...", "🙂", "'s", "\r\n", "é", "x1", "_", "ﬁ", "<|endoftext|>", "<|endof", "text|>"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        ids = words(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_and_rows_without_an_id(spark):
    rows = [(1, "<|endoftext|>"), (None, "a <|endoftext|> b"), (None, None), (2, "x " * 5000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = Counter({r["doc_id"]: 0 for r in found})
    for r in found:
        total[r["doc_id"]] += r["length"]
    expected = Counter({1: 0, 2: 0, None: 0})
    for key, text in rows:
        expected[key] += len(tokenizer().encode(text or "", add_special_tokens=False).ids) + 1
    assert total == expected and total[1] == 2


def fewest(items, capacity):
    """The least number of bins, by trying all ways."""
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_local_search_against_all_ways():
    rng, over, made = random.Random(21), 0, 0
    for _ in range(150):
        items = sorted((rng.randrange(15, 60) for _ in range(rng.randrange(6, 12))), reverse=True)
        bins = packing.improve(packing.best_fit(Counter(items), 100), 100)
        least = fewest(items, 100)
        over, made = over + sum(bins.values()) - least, made + least
        assert sum(bins.values()) <= least + 1
    assert over <= 0.02 * made


def test_local_search_ends_where_no_exchange_gains():
    rng, better = random.Random(22), 0
    squares = lambda bins: sum(n * sum(k) ** 2 for k, n in bins.items())
    for _ in range(40):
        counts = Counter(rng.randrange(20, 70) for _ in range(60))
        start = packing.best_fit(counts, 100)
        bins = packing.improve(start, 100)
        better += squares(bins) > squares(start)
        if sum(bins.values()) > -(-sum(k * n for k, n in counts.items()) // 100):
            under = [k for k in bins if sum(k) < 100]
            for high in under:
                for low in under:
                    if sum(low) <= sum(high) and (low != high or bins[low] > 1):
                        gap = 100 - sum(high)
                        assert not any(0 < a - b <= gap for a in low for b in (0, *high))
    assert better > 5


def test_local_search_never_opens_bins():
    rng = random.Random(2)
    for _ in range(20):
        counts = Counter(rng.choice([rng.randrange(1, 100), rng.randrange(30, 60)]) for _ in range(rng.randrange(1, 300)))
        bins = packing.best_fit(counts, 100)
        better = packing.improve(bins, 100)
        for found in (bins, better):
            assert sum((Counter({x: n * c for x, c in Counter(kind).items()}) for kind, n in found.items()), Counter()) == counts
            assert all(sum(k) <= 100 for k in found)
        assert sum(better.values()) <= sum(bins.values())
    assert sum(packing.improve(Counter({(60,): 1, (30, 30): 1, (40,): 2}), 100).values()) == 2


# --- op3


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = fold(text)
        if item is not None:
            for i in range(max(len(w) - size, 0) + 1 if w else 0):
                windows[tuple(w[i : i + size])].add(item)
    out = []
    for key, text in docs:
        w, hit, found = fold(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        names = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "Beta, GAMMA delta epsilon zeta eta theta iota kappa lambda mu"), (10, "one two"), (2, None), (3, ""), (None, "alpha beta"), (10, "two"), (11, "w1 w2 w3")]


@pytest.mark.parametrize("block", [2000, 2])
def test_decontamination_odd(spark, odd, empty, block, monkeypatch):
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (block,))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontam.digest(odd, bench).collect(), contaminated(texts(odd), ITEMS))
    assert decontam.digest(empty, bench).count() == 0
    none = decontam.digest(odd, bench.limit(0)).collect()
    assert len(none) == len(odd_rows()) and not any(r["contaminated"] for r in none)


def test_decontamination(spark, documents, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    expected = contaminated(texts(documents), items)
    same(decontam.digest(documents, bench).collect(), expected)
    assert any(e[-1] for e in expected)
    assert {r["doc_id"] for r in decontam.clean(documents, bench).collect()} == {e[0] for e in expected if not e[-1]}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x x c"), (2, "c a"), (3, "a"), (4, "c b a"), (5, None)], "doc_id long, text string")
    index = decontam.build_index(docs, segment_bytes=20)
    assert {r["doc_id"] for r in decontam.proximity(index, "a c", 2).collect()} == {2, 4}
    assert {r["doc_id"] for r in decontam.proximity(index, "a c", 4).collect()} == {1, 2, 4}


# --- op4


def test_language_id(documents, odd, empty):
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    rows = langid.digest(documents).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    for r, text in zip(langid.digest(odd).collect(), [t for _, t in texts(odd)], strict=True):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.digest(empty).count() == 0


# --- op5


def counts_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for j in range(i, i + 3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(marked)


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_quality(name, request, spark, sf_dir):
    df = request.getfixturevalue(name)
    rows = quality.digest(df, table(spark, sf_dir, "labels")).collect()
    same([r[:6] for r in rows], [(k, *counts_of(t)) for k, t in texts(df)])
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["rule"])


def test_measure_random():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["a ", "b ", "a b c ", "\n", "\x0b", "\u00a0", "é ", "#", "<$", "\x85", "c\n"]) for _ in range(rng.randrange(40)))
        assert quality.measure(text.encode())[:5] == counts_of(text)


def test_rules_are_learned():
    rng = random.Random(4)
    rows = [(tuple(rng.random() for _ in range(10)), False) for _ in range(3000)]
    rows = [(x, x[2] > 0.9 and x[4] < 0.5) for x, _ in rows]
    rules = quality.learn(rows)
    wrong = sum(any(quality.covers(r, x) for r in rules) != y for x, y in rows)
    assert rules and wrong < 60
    assert quality.learn([]) == [] and quality.learn(rows[:1]) == []


def test_training_rows_about_the_bound(spark):
    words = [f"w{k}" for k in range(60)]
    documents = spark.createDataFrame([(k, " ".join([*words, f"x{k}"])) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    for sample, least in ((50, 40), (40, 40), (39, 39), (37, 37), (20, 10)):
        rows = quality.training_rows(documents, labels, Scratch(spark, "bound"), sample=sample)
        assert least <= len(rows) <= sample


# --- op6


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()


def brute_groups(docs, size=3, percent=90):
    sets = [(k, shingle_set(t, size)) for k, t in docs]
    root = {k: k for k, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and None not in (a, b) and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return [(k, len(s), None if k is None else find(k) if s else k) for k, s in sets]


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(name, size, percent, request):
    df = request.getfixturevalue(name)
    same(ngram_join.groups(df, size, percent).collect(), brute_groups(texts(df), size, percent))


def test_ngram_join_near_copies(spark):
    """Chains of links, a family around a base text, and a passage that all share."""
    rng, rows = random.Random(6), []
    word = lambda: f"t{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    for family in range(6):
        text = [word() for _ in range(rng.choice([30, 120, 200]))]
        for _ in range(40):
            if family % 2:
                text = list(text)
                copy = text
            else:
                copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.randrange(10**6), " ".join(copy)))
    rows += [(rng.randrange(10**6), " ".join(passage + [word() for _ in range(rng.randrange(1, 80))])) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 90), (5, 80)):
        same(ngram_join.groups(df, size, percent).collect(), brute_groups(rows, size, percent))


def test_large_sets_meet_only_their_like(spark, monkeypatch):
    """Unrelated texts that share some shingles by chance are no candidates; links about the bound of ``large`` are all found."""
    rng, rows, tried = random.Random(31), [], []
    word = lambda: f"t{rng.randrange(80)}"
    for k in range(50):
        rows.append((k, " ".join(word() for _ in range(2600))))
    plain = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *args: tried.append(pairs.distinct().count()) or plain(pairs, *args))
    same(ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute_groups(rows))
    assert sum(tried) < 100  # of 1,225 pairs
    near = []
    for size, percent in ((3, 90), (5, 80)):
        n = ngram_join.large(percent)
        for family in range(10):
            words = [f"u{rng.randrange(10**6)}" for _ in range(n + rng.randrange(-n // 10, n // 10))]
            for _ in range(4):
                copy = list(words)
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(1, n // 8)] = []
                for _ in range(rng.randrange(1 + n * (100 - percent) // 100 // size)):
                    copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**6)}"
                near.append((len(near), " ".join(copy)))
        same(ngram_join.groups(spark.createDataFrame(near, "doc_id long, text string"), size, percent).collect(), brute_groups(near, size, percent))


def test_rows_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    rows = spark.range(0, 2000, 1, 1).select(F.expr("cast(repeat('x', 20000) as binary)").alias("x"))
    found = [r["bytes"] for r in Scratch(spark, "t").table(rows.mapInArrow(sizes, "bytes long"), "sizes").collect()]
    assert sum(found) >= 4 * 10**7 and max(found) < 10**7
    assert spark.conf.get(key, None) == before


def test_ids_of_several_texts_are_one_document(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (3, "e f g h"), (4, "i j k l")]
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_connected(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = connected(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {r["id"]: r["root"] for r in found} == {x: root[x] for p in pairs if p[0] != p[1] for x in p} and len({r["id"] for r in found}) == len(found)


# --- op7


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé🙂") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_line_dedup(spark, odd, empty):
    rng = random.Random(9)
    line = lambda n=30: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b = line(60), line(60)
    near = a.replace(a.split()[30], "changed")
    rows = [(5, f"{a}\nshort\n{b}"), (3, f"{line()}\n{near.upper()}"), (7, f"{b}\nshort"), (8, b), (9, "short\nother"), (10, None), (11, "日本語の行です\n")]
    found = {r["doc_id"]: r for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {k: t for k, t in rows}
    assert found[3]["text"] == text[3] and found[9]["text"] == "other" and found[10]["text"] is None and found[11]["text"] == text[11]
    assert found[7]["text"] == "" and found[8]["text"] == "" and found[8]["n_removed"] == 1
    assert found[5]["text"] == f"short\n{b}"
    left = line_dedup.dedup(odd)
    assert left.columns == [*odd.columns, "n_lines", "n_removed"] and left.count() == len(odd_rows())
    clash = line_dedup.dedup(odd.withColumns({"n_lines": F.lit("x"), "keys": F.lit(1), "root": F.lit(2)}))
    assert clash.where("n_lines >= 0").count() == len(odd_rows()) and {"keys", "root"} <= set(clash.columns)
    kept = left.where("doc_id = 2").collect()
    assert len(kept) == 2 and kept[0]["text"] == kept[1]["text"]
    assert line_dedup.digest(empty).count() == 0


def line_groups(spark, lines):
    """The group of each line, a document a line."""
    store = Scratch(spark, "t")
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    distinct, linked = line_dedup.groups(rows, store)
    root = {r["id"]: r["root"] for r in linked.collect()}
    at = {lines[r["doc_id"]].casefold(): root.get(r["id"], r["id"]) for r in distinct.collect()}
    return [at[x.casefold()] for x in lines]


def test_line_dedup_recall(spark):
    """Nine in ten pairs of similarity 0.8 or more are found, by words in a line and words changed."""
    rng, lines, kinds = random.Random(13), [], []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11)))
    pool = [word() for _ in range(4000)]
    for n, changed in ((60, 1), (60, 3), (60, 6), (60, 10), (20, 1), (20, 3), (12, 2), (10, 2), (8, 1), (6, 1), (5, 1)):
        for _ in range(150):
            a = [rng.choice(pool) for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), changed):
                b[k] = rng.choice(pool)
            lines += [" ".join(a), " ".join(b)]
            kinds.append((n, changed))
    found, hit, of = line_groups(spark, lines), Counter(), Counter()
    for i, kind in enumerate(kinds):
        a, b = lines[2 * i], lines[2 * i + 1]
        if a != b and line_dedup.similar(a, b):
            of[kind] += 1
            hit[kind] += found[2 * i] == found[2 * i + 1]
    print({k: round(hit[k] / of[k], 3) for k in of})
    assert len(of) >= 9 and all(hit[k] >= 0.9 * of[k] for k in of if of[k] >= 20)


def test_line_dedup_brute_force(spark):
    """Groups are those of all pairs of similarity 0.8, short and unspaced lines among them."""
    rng, lines = random.Random(14), []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 6, 15, 30]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            if len(copy) > 10:
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            lines.append(" ".join(copy))
    lines += ["日本語の文字列は空白なしで書かれます", "日本語の文字列は空白なしで書かれた", "別の行がここにあります"]
    found = line_groups(spark, lines)
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if line_dedup.similar(lines[i].casefold(), lines[j].casefold()):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    ours = {(i, j) for i in range(len(lines)) for j in range(i) if found[i] == found[j]}
    theirs = {(i, j) for i in range(len(lines)) for j in range(i) if root[i] == root[j]}
    assert ours <= theirs and len(ours) >= 0.95 * len(theirs)


def test_line_dedup_makes_every_link_of_its_buckets(spark, monkeypatch):
    """All similar lines that meet in a bucket are joined, though their groups have closer pairs that are not similar."""
    from graphlens.llm import components

    monkeypatch.setattr(components, "FULL", 2)
    rng, lines = random.Random(21), []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(30)]
        for _ in range(8):  # moved runs of words leave the SimHash as it is
            lines.append(" ".join(words))
            at = rng.randrange(27)
            run, words = words[at : at + 3], words[:at] + words[at + 3 :]
            to = rng.randrange(28)
            words = words[:to] + run + words[to:]
            if rng.random() < 0.3:
                words[rng.randrange(30)] = f"w{rng.randrange(3000)}"
    lines = sorted(set(lines))
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    mask, buckets, root = (1 << line_dedup.BLOCK_BITS) - 1, defaultdict(set), list(range(len(lines)))
    found = {r["doc_id"]: r for r in line_dedup.distinct_lines(rows).collect()}
    for i, r in found.items():
        for k in [*r["keys"], *((b, r[s] >> b % 2 * line_dedup.BLOCK_BITS & mask) for b, s in enumerate(("s1", "s1", "s2", "s2")))]:
            buckets[k].add(i)
    for i, j in {(i, j) for b in buckets.values() for i in b for j in b if i < j}:
        bits = sum((found[i][s] ^ found[j][s]).bit_count() for s in ("s1", "s2"))
        if bits <= line_dedup.HAMMING and line_dedup.similar(lines[i], lines[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    ours = line_groups(spark, lines)
    n = range(len(lines))
    assert {(i, j) for i in n for j in range(i) if ours[i] == ours[j]} == {(i, j) for i in n for j in range(i) if root[i] == root[j]}


def test_line_dedup_exact_copies(documents):
    """Of equal normalised lines exactly one occurrence stays; others that go are like another."""
    found = line_dedup.digest(documents).collect()
    before = Counter(" ".join(w) for _, t in texts(documents) for x in (t or "").split("\n") if (w := line_dedup.normalise(x)))
    after = Counter(" ".join(w) for r in found for x in (r["text"] or "").split("\n") if (w := line_dedup.normalise(x)))
    assert max(after.values()) == 1 and set(after) <= set(before)
    gone = [x for x in before if x not in after]
    for x in gone:
        assert any(line_dedup.similar(x, y) for y in before if y != x and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)))


# --- op8


def archive(records):
    return b"".join(records)


def record(key, payload, length=None):
    n = len(payload) if length is None else length
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{key}>\r\nContent-Length: {n}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def expected_pages(rows):
    best = {}
    for key, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            best[raw] = max(best.get(raw, key), key)
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and best[raw] != key
        out.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[raw] if again else None))
    return out


def test_warc_odd(spark):
    nested = record(99, b"inner").decode()
    rows = [
        (1, "http://a/\r\nWARC/1.1\r\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n" * 50),
        (6, "u", f"head {nested} tail"), (7, "u", nested), (8, "u", "é🙂\x00" * 400), (9, "u", "é🙂\x00" * 400), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5"),
        (13, "u", "y" * 400_000), (14, "http://x/WARC/1.1/WARC/1.", "WARC/1.0 \r\nWARC/1.WARC/1.1\r\nx"),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, size long, sha1 string")
    same(warc.round_trip(df).collect(), expected_pages(rows))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    same(warc.round_trip(pages).collect(), expected_pages([tuple(r) for r in pages.select("page_id", "url", "html").collect()]))


def test_warc_records_are_whole(spark, tmp_path):
    """Each record has the fields that the format demands, and its length is right."""
    rows = [(k, f"http://h/{k}", "p" * (900 + 100 * (k % 3))) for k in range(30)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), Scratch(spark, "w"))
    raw, n = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*"))), 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert first == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert fields["WARC-Type"] == "response" or fields["WARC-Profile"] == warc.PROFILE
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        raw, n = rest[size + 4 :], n + 1
    assert n == 30


def test_warc_old_version_and_header_case(spark, tmp_path):
    one = record(1, b"abc").replace(b"WARC/1.1", b"WARC/1.0").replace(b"Content-Length:", b"content-length:").replace(b"WARC-Record-ID: ", b"warc-record-id:\t")
    (tmp_path / "a.warc").write_bytes(one + record(2, b"de"))
    rows = warc.read(spark, str(tmp_path), Scratch(spark, "w"), payloads=True).withColumn("page", warc.page_of(F.col("id"))).collect()
    assert {r["page"]: bytes(r["payload"]) for r in rows} == {1: b"abc", 2: b"de"}


def test_warc_foreign_archives(spark, tmp_path):
    """Byte ranges cut anywhere; nested records and a broken chain."""
    rng = random.Random(10)
    payloads = [bytes(rng.randrange(32, 127) for _ in range(rng.randrange(300))) + (record(500 + i, b"in") if i % 5 == 0 else b"") for i in range(200)]
    (tmp_path / "a.warc").write_bytes(b"".join(record(i, p) for i, p in enumerate(payloads)))
    (tmp_path / "b.warc").write_bytes(record(900, b"first") + b"garbage" + record(901, b"lost"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
        rows = warc.read(spark, str(tmp_path), Scratch(spark, "w"), payloads=True).withColumn("page", warc.page_of(F.col("id"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["page"]: bytes(r["payload"]) for r in rows} == dict(enumerate(payloads)) | {900: b"first"} and len(rows) == 201


# --- op9


def verdict_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark, sf_dir):
    odd = [None, "", "://", "http://", "http://COM/en/x", "x://a.Example.com/en/7?q=/", "a://b://c/d", "HTTP://Ä.net/de/#", "http://example.net/de/8", "http://xcom/en/", "http://h/p\n://q", "http://" + "a" * 50_000]
    pages = [(r["page_id"], r["url"]) for r in table(spark, sf_dir, "pages").collect()]
    rows = pages + [(10_000 + i, u) for i, u in enumerate(odd)] + [(None, "http://com/en/")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, host string, length long")
    found = urls.judge(df).collect()
    expected = [(k, *verdict_of(u)) for k, u in rows]
    same([r[:4] for r in found], [e[:4] for e in expected])
    known = {e[0]: e[4] for e in expected}
    assert all(r["verdict"] in ("allow", "block") and (known[r["id"]] is None or r["verdict"] == known[r["id"]]) for r in found)
    assert urls.judge(df.limit(0)).count() == 0


def test_trees_learn():
    rng = random.Random(11)
    rows = [((rng.randrange(32), rng.randrange(8), rng.randrange(4)), 0, 1) for _ in range(2000)]
    rows = [(x, int((x[0] > 15) != (x[1] > 3)), n) for x, _, n in rows]
    base, forest = urls.boost(rows)
    wrong = sum((base + sum(urls.evaluate(t, x) for t in forest) > 0) != (y == 1) for x, y, _ in rows)
    assert wrong < 40 and urls.boost([]) == (0.0, [])


# --- op10


def test_licenses(spark, documents, odd, empty):
    rows = [
        ("p/LICENSE", "Released under the MIT License."), ("p/a/x.py", "code"), ("p/a/b/LICENSE", "\n Licensed under CC BY-NC 4.0.\nmore"), ("p/a/b/c/y.py", None),
        ("p/a/b/z.py", "code\nLicensed under the Apache License, Version 2.0."), ("q/x", "the license of nothing in particular at all"), ("top", ""), (None, "code"),
        ("p/a/b/c/y.py", None),
    ]
    found = licenses.scan(spark.createDataFrame([(*r, "z", 1) for r in rows], "path string, text string, term string, row long")).collect()
    got = Counter((r["path"], r["license"], r["origin"], r["license_dir"]) for r in found)
    assert got == Counter([
        ("p/LICENSE", "MIT", "licence_file", None), ("p/a/x.py", "MIT", "inherited", "p"), ("p/a/b/LICENSE", "CC-BY-NC-4.0", "licence_file", None),
        ("p/a/b/c/y.py", "CC-BY-NC-4.0", "inherited", "p/a/b"), ("p/a/b/c/y.py", "CC-BY-NC-4.0", "inherited", "p/a/b"), ("p/a/b/z.py", "Apache-2.0", "header", None),
        ("q/x", None, "none", None), ("top", None, "none", None), (None, None, "none", None),
    ])
    assert licenses.scan(licenses.corpus_paths(odd)).count() == len(odd_rows())
    assert licenses.scan(licenses.corpus_paths(empty)).count() == 0
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "CC BY-NC": "CC-BY-NC-4.0", "GNU General": "GPL-3.0"}
    truth = {k: {v for n, v in names.items() if n in (t or "")} for k, t in texts(documents)}
    for r in licenses.scan(licenses.corpus_paths(documents)).collect():
        known = truth[int(re.search(r"[0-9]+$", r["path"])[0])]
        assert (r["own"] in known) if r["own"] else not known


def test_column_marks_do_not_decide_the_simhash():
    from graphlens.llm.line_dedup import HAMMING, Words, simhashes

    rows = [[w for k in range(20) for w in (f"{tag}{k}", "|")] for tag in ("left", "right")]
    one, two = simhashes([*rows], Words())
    assert sum(int(x ^ y).bit_count() for x, y in zip(one, two, strict=True)) > HAMMING
    assert (simhashes([["a", "b", "b"]], Words()) == simhashes([["b", "a"]], Words())).all()


def test_edit_distance_lies_between_its_bounds():
    rng = random.Random(3)
    for _ in range(500):
        one = [f"{rng.choice('abcd')}{rng.randrange(20)}" for _ in range(rng.randrange(1, 40))]
        two = one[3:] + one[:3] if rng.random() < 0.2 else list(one)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(two) + 1)
            two[k : k + rng.randrange(2)] = ["zz"] * rng.randrange(2)
        a, b = " ".join(one), " ".join(two)
        assert line_dedup.least_distance(a, b) <= line_dedup.edit_distance(a, b) <= line_dedup.most_distance(a, b)


def test_simhash_is_the_majority_of_word_hashes():
    lines = [[f"w{k}" for k in range(n)] for n in (5, 256, 600)] + [["é", "ß", "\ud800", "x", "y"]]
    for words, mark in zip(lines, line_dedup.simhashes(lines, line_dedup.Words()), strict=True):
        ones = sum(np.unpackbits(line_dedup.Words().hashes([w])[0]).astype(int) for w in words)
        assert (np.packbits(2 * ones > len(words)) == mark).all()


def test_every_line_is_deduplicated_whatever_its_words(spark):
    """Short lines and lines of scripts without spaces: one occurrence of each stays."""
    long = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(80))
    near = long[:40] + "龥" + long[41:]
    rows = [(1, f"}}\nshort\n\n{long}"), (2, f"SHORT\n \n{long}\nnew"), (3, f"one  two\n}}\n{near}"), (4, "ไม่มีช่องว่าง\nOne two\nไม่มีช่องว่าง")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == rows[0][1] and found[2] == " \nnew" and found[4] == "ไม่มีช่องว่าง"
    assert found[3] in ("one  two", f"one  two\n{near}")  # SimHash may miss the changed character


def test_query_deduplicates_short_lines(spark, documents, sf_dir):
    from graphlens.llm import queries

    count = lambda rows: Counter(" ".join(w) for t in rows for x in (t or "").split("\n") if (w := line_dedup.normalise(x)))
    before = count(t for _, t in texts(documents))
    after = count(r["text"] for r in queries.op7_line_dedup(spark, sf_dir).collect())
    assert any(n > 1 and len(x.split()) < 5 for x, n in before.items())
    assert max(after.values()) == 1 and set(after) <= set(before)


def test_all_of_a_long_text_names_its_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    classify = langid.Classifier(langid.train(docs))
    prose = {}
    for lang in ("en", "de"):
        text = "\n".join(r["text"] for r in docs.where(F.col("lang") == lang).orderBy("doc_id").select("text").collect() if r["text"])
        prose[lang] = (text * (1_000_000 // len(text) + 1))[:1_000_000]
    short, long = classify(prose["de"][:30_000]), classify(prose["de"])
    assert short[0] == long[0] == "de" and not long[2] and abs(short[1] - long[1]) < 0.15
    assert classify(prose["de"][:50_000] + "\n" + prose["en"])[0] == "en"


def test_every_language_is_learned(spark):
    rows = [(k, f"word{k} " * 20, f"l{k:02}") for k in range(70)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == 70


def test_suffix_statistics_reach_urls_without_a_rule(spark):
    rows = [f"http://h.{end}/{k % 90 + 10}" for k in range(300) for end in ("com/en", "net/de")] + ["http://h.com/zz/55", "http://h.net/zz/55"]
    found = {r["id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert found[600]["rule"] is None and found[600]["score"] > 0.9 and found[600]["verdict"] == "block"
    assert found[601]["rule"] is None and found[601]["score"] < 0.1 and found[601]["verdict"] == "allow"


def test_entropy_is_of_the_whole_url(spark):
    row = spark.createDataFrame([("a" * 2048 + "bcdefgh" * 600,)], "url string").select(urls.features(F.col("url"), F.lit(""), F.lit(""))["entropy"].alias("e")).first()
    assert row["e"] > 8


def test_quality_stage_judges_each_row(spark, monkeypatch):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality long")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(None, good), (None, "few words"), (1, good), (1, "few words"), (1, good), (2, None), (3, good + " x")]
    kept = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    same(kept, [r for r in rows if r[1] and len(r[1].split()) >= 50])


def test_wrapped_headers_and_identifiers_are_licences(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    marked = lambda t, m: "\n".join(m + x for x in t.split("\n"))
    rows = [
        ("a/x.py", marked(gpl, "# ") + "\nimport os", "GPL-3.0", "header"), ("b/x.c", "/*\n" + marked(mpl, " * ") + "\n */\nint x;", "MPL-2.0", "header"),
        ("c/x.rs", "// SPDX-License-Identifier: MIT\nfn x() {}", "MIT", "header"), ("d/x.go", "// SPDX-License-Identifier: Apache-2.0\npackage x", "Apache-2.0", "header"),
        ("e/COPYING", gpl + "\n\nmore", "GPL-3.0", "licence_file"), ("e/f/x", "code", "GPL-3.0", "inherited"), ("a/y", "code", None, "none"), ("c/y", "code", None, "none"),
    ]
    found = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()
    assert {(r["path"], r["license"], r["origin"]) for r in found} == {(p, v, o) for p, _, v, o in rows}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_whole_licence_files_and_source_headers(spark):
    marked = lambda t, m: "\n".join((m + x).rstrip() for x in t.split("\n"))
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    rows = [
        ("a/LICENSE", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + BSD, "BSD-3-Clause", "licence_file"), ("a/x.py", "x = 1", "BSD-3-Clause", "inherited"),
        ("b/COPYING.txt", BSD.replace(BSD[BSD.index("3. Neither") : BSD.index("THIS SOFT")], ""), "BSD-2-Clause", "licence_file"),
        ("c/x.py", marked(BSD, "# ") + "\n\nimport os\n", "BSD-3-Clause", "header"), ("c/y.py", "y = 2", None, "none"),
        ("d/x.java", "/*\n" + marked(APACHE, " * ") + "\n */\npackage x;", "Apache-2.0", "header"), ("d/y.java", "package y;", None, "none"),
        ("e/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0", "licence_file"),
        ("f/x.c", "/* " + lgpl + " */\nint x;", "LGPL-2.1", "header"),
    ]
    found = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()
    assert {(r["path"], r["license"], r["origin"]) for r in found} == {(p, v, o) for p, _, v, o in rows}


def test_packages_sql(spark, sf_dir):
    """All SQL of the package runs and gives the queries' rows."""
    import duckdb

    from graphlens.llm import queries

    duck = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        ours = queries.queries()[name](spark, sf_dir)
        columns = sorted(ours.columns)
        theirs = duck.sql(sql).project(", ".join(columns)).fetchall()
        same(ours.select(*columns).collect(), theirs)


def test_pipeline_stages(spark, tmp_path, sf_dir):
    """Each stage against brute force on its own input, with null and repeated ids."""
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").limit(120)
    extra = [(None, "word " * 60, "en", "x", 1), (None, None, None, None, None), (10**6, "", "en", "x", 0), (10**6, "", "en", "x", 0)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    store = Scratch(spark, "t")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    one = store.table(stage["quality rules"](spark, rows, sf_dir), "one")
    assert one.columns == docs.columns
    judged = Counter()
    for r in quality.judge(rows, table(spark, sf_dir, "labels")).collect():
        judged[tuple(r["row"])] += r["kept"]
    same(one.collect(), judged.elements())
    assert all(len((r["text"] or "").split()) >= 50 for r in one.collect())
    two = store.table(stage["line dedup"](spark, one, sf_dir), "two")
    lines = Counter(" ".join(line_dedup.normalise(x)) for r in two.where("doc_id is not null").collect() for x in (r["text"] or "").split("\n") if line_dedup.normalise(x))
    assert two.columns == docs.columns and max(lines.values()) == 1 and all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = store.table(stage["n-gram Jaccard join"](spark, two, sf_dir), "three")
    groups = {k: c for k, _, c in brute_groups([t for t in texts(two) if t[0] is not None], 5, 80)}
    same([r["doc_id"] for r in three.collect()], [r["doc_id"] for r in two.collect() if r["doc_id"] is None or groups[r["doc_id"]] == r["doc_id"]])
    four = store.table(stage["benchmark decontamination"](spark, three, sf_dir), "four")
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = [e[0] for e in contaminated(texts(three), items) if not e[-1]]
    same([r["doc_id"] for r in four.collect()], clean)
    five = stage["best-fit packing"](spark, four, sf_dir).collect()
    assert sum(r["length"] for r in five) == sum(len(tokenizer().encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(four))
    none = rows.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, sf_dir).count() == 0, name


def test_rows_go_by_key_however_many(spark, monkeypatch):
    from graphlens.llm import common

    rows = spark.range(2000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"), F.lit("x").alias("__gone"))
    gone = Scratch(spark, "t").table(spark.range(0, 2000, 3).select(F.col("id").alias("k")), "gone")
    expected = [r["k"] for r in rows.collect() if r["k"] is None or r["k"] % 3]
    for limit in (10**6, 10):
        monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
        left = common.without(rows.drop("__gone"), F.col("k"), gone)
        same([(r["k"],) for r in left.collect()], [(k,) for k in expected])
