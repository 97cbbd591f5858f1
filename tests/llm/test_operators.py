"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, graph, html_text, passages, pii, shards, simhash, substrings, suffixes, toxicity, vectors, warc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def corpus(n=120, seed=7):
    """Texts that share words and passages, with copies, near copies, empty, null and long ones."""
    rng = random.Random(seed)
    words = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(60)]
    shared = [" ".join(rng.choices(words, k=30)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60)))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        texts.append("\n".join(parts))
    texts += texts[:10] + [None, "", " \t\n", "a" * 3000, "a" * 2999 + "b", "xy " * 900, "ß漢😀" * 40, "ß漢😀" * 41]
    texts += [t.replace("w1 ", "w2 ") for t in texts[10:20]]
    return list(enumerate(texts))


SCHEMA = "doc_id long, text string, id string, shard int, fp long, leaks string, p_toxic string, pii_card string, `__text` string, n_words string"


def frame(spark, rows):
    """As documents, with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "l", "p", "c", "t", "n") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and repeated ids with other texts."""
    text = " ".join(f"t{k}" for k in range(40))
    return frame(spark, [(5, text), (5, text), (5, None), (None, text), (None, "other"), (1, text + " end"), (2, "")])


def windows_removed(rows, length, split):
    first = {}
    items = sorted((i, split(t)) for i, t in rows)
    for i, x in items:
        for k in range(len(x) - length + 1):
            first.setdefault(tuple(x[k : k + length]), i)
    out = {}
    for i, x in items:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if first[tuple(x[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (x, gone)
    return out


# ---- 1 substrings, 10 passages


def test_substrings_against_brute_force(docs):
    want = windows_removed(corpus(), 13, lambda t: WORD.findall(t or ""))
    got = {r["doc_id"]: r for r in substrings.deduplicate(docs).collect()}
    assert len(got) == len(want)
    for i, (x, gone) in want.items():
        assert got[i]["kept_text"] == " ".join(w for w, g in zip(x, gone) if not g), i
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(x), sum(gone))
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == sum(gone)


def thue_morse(n, flip):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


@pytest.mark.parametrize("letters", [64, 1024, 2048])
def test_substrings_tell_long_words_apart(spark, letters):
    """Words whose polynomial hashes are equal whatever the base; the rest of the window is the same."""
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{thue_morse(letters, 0)} {rest}"), (2, f"{thue_morse(letters, 1)} {rest}"), (3, f"{thue_morse(letters, 1)} {rest}")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("sorted_at_once", [4 << 20, 300])
def test_passages_against_brute_force(docs, monkeypatch, sorted_at_once):
    monkeypatch.setattr(passages, "SORTED", sorted_at_once)
    want = windows_removed(corpus(), 50, lambda t: list((t or "").encode()))
    got = {r["doc_id"]: r for r in passages.deduplicate(docs).collect()}
    for i, (x, gone) in want.items():
        assert bytes(got[i]["kept"]) == bytes(b for b, g in zip(x, gone) if not g), i
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(x), sum(gone))
        assert len(got[i]["spans"]) == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


def test_odd_rows_of_dedup(odd):
    """Rows that share an id take nothing from one another; a null id comes last."""
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.deduplicate(odd).collect())
    assert got == sorted([("1", 41, 0), ("2", 0, 0), ("5", 0, 0), ("5", 40, 40), ("5", 40, 40), ("None", 1, 0), ("None", 40, 40)])
    size = len(" ".join(f"t{k}" for k in range(40)))
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in passages.deduplicate(odd).collect())
    assert got == sorted([("1", 0), ("2", 0), ("5", 0), ("5", size), ("5", size), ("None", 0), ("None", size)])


@pytest.mark.parametrize("operator", [substrings.deduplicate, passages.deduplicate, simhash.near_duplicates, simhash.representatives])
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).collect() == []


def test_minimizers_spread_over_key_shards():
    rng = np.random.default_rng(0)
    lowest, _ = shards.minimizers(rng.integers(0, 2**63, 100_000).astype(np.uint64), np.ones(99_974, bool), 27)
    sizes = np.diff(shards.bounds(np.sort(shards.mix(np.unique(lowest))), 16))
    assert sizes.max() < 1.5 * sizes.mean()


def test_induced_sorting_against_sorting():
    rng = random.Random(3)
    for _ in range(60):
        letters = rng.choice(["ab", "a", "abcdefgh"])
        text = suffixes.encoded([bytes(rng.choice(letters).encode()[0] for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))])
        depth, raw = rng.choice([1, 2, 5, 50]), text.tobytes()
        at, lcp = [], []
        for x, y in suffixes.induced(text, depth, memory=rng.choice([1, 200, 1 << 20])):  # the small ones go to disk
            at += x.tolist()
            lcp += y.tolist()
        assert sorted(at) == list(range(len(raw)))
        for k in range(1, len(at)):
            a, b = raw[at[k - 1] :], raw[at[k] :]
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert a[:depth] >= b[:depth] and lcp[k] == min(same, depth)


# ---- 2 private data

PRIVATE = "mail A.b9@mail6.example.com, +1 (683) 555-6293 4111 1111 1111 1111 ok 57.96.160.157. Born 1985-03-12 or 03/25/1999, 123-45-6789, IBAN DE89 3704 0044 0532 0130 00 end, password=e3b3ed3cc8548923d6"


def test_pseudonyms_keep_format_and_come_back():
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    new, counts = there.replace(PRIVATE)
    assert counts == {"email": 1, "phone": 1, "card": 1, "ip": 1, "date": 2, "ssn": 1, "iban": 1, "credential": 1}
    for secret in ("A.b9", "683", "1111 1111", "57.96", "1985", "123-45", "DE89 3704", "e3b3ed3c"):
        assert secret not in new
    card = re.search(r"(\d{4} \d{4} \d{4} \d{4}) ok", new)[1]
    assert pii.luhn(card.replace(" ", "")) == 0
    assert back.replace(new)[0] == PRIVATE
    assert there.replace("4111111111111111")[0] == card.replace(" ", "")  # linked whatever the separators
    assert pii.Pseudonyms(b"other").replace(PRIVATE)[0] != new


def test_only_valid_values_are_replaced():
    text = "4111111111111112 999.1.1.1 2001-02-30 000-12-3456 version 4.0. DE00 3704 0044 0532 0130 00"
    assert pii.Pseudonyms(b"key").replace(text) == (text, {})


def test_every_address_and_credentials_without_digits():
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    for text in ("to 248.40.198.62 and", "224.0.0.1", "255.255.255.255", "0.0.0.0", "0.12.3.4"):
        new, counts = there.replace(text)
        assert counts == {"ip": 1} and new != text and back.replace(new)[0] == text
        first, other = (int(re.search("[0-9]+", x)[0]) for x in (text, new))
        assert (first == 0, first > 223) == (other == 0, other > 223)
    for text in ("password=correcthorse", "api_key: 'QwertyUiop'", 'token = "deadbeefcafe"'):
        new, counts = there.replace(text)
        assert counts == {"credential": 1} and new != text and back.replace(new)[0] == text


def test_equal_values_stay_linked_in_every_notation():
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)

    def one(text):
        new, counts = there.replace(text)
        assert sum(counts.values()) == 1 and new != text and back.replace(new)[0] == text, text
        return new

    for month_first, day_first, iso in (("12/25/2020", "25/12/2020", "2020-12-25"), ("03/31/1999", "31.03.1999", "1999/03/31")):
        days = set()
        for text, order in ((month_first, (2, 0, 1)), (day_first, (2, 1, 0)), (iso, (0, 1, 2))):
            parts = re.split("[-/.]", one(text))
            days.add(tuple(parts[k] for k in order))
        assert len(days) == 1
    digits = lambda x: re.sub("[^0-9]", "", x)
    for numbers in (("+351912345678", "+351 912 345 678", "+351-912-345-678"), ("+16835556293", "+1 (683) 555-6293", "1-683-555-6293"), ("+442079460958", "+44 20 7946 0958")):
        assert len({digits(one(x)) for x in numbers}) == 1
        assert all(one(x).startswith(re.match(r"\+?(351|1|44)", x)[0]) for x in numbers)
    assert digits(one("(683) 555-6293")) == digits(one("+1 683 555 6293"))[1:]


def test_no_value_is_too_long():
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    rng = random.Random(8)
    for n in (7, 128, 200, 5000, 300_000):
        secret = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789", k=n))
        for text in (f"say password={secret} now", f"to {secret}@example.com now", f"to a@{'x' * n}.{'y' * 40}.example.museumofmodernartists"):
            new, counts = there.replace(text)
            assert sum(counts.values()) == 1 and back.replace(new)[0] == text
            if secret in text:  # no run of the secret stays
                at = text.index(secret)
                assert all(new[at + k : at + k + 20] != text[at + k : at + k + 20] for k in range(0, n - 20, 20))
    assert there.replace("password=P@ssw0rd!")[0].endswith("!") and "P@ssw0rd" not in there.replace("password=P@ssw0rd!")[0]


def test_pseudonyms_against_planted_values(spark):
    """Every planted value goes, by the same pseudonym everywhere; different ones stay different; the rest stays."""
    rng = random.Random(12)

    def card():
        body = "4" + "".join(rng.choices("0123456789", k=14))
        return next(body + str(k) for k in range(10) if pii.luhn(body + str(k)) == 0)

    makers = {
        "card": card,
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "phone": lambda: f"+49 {rng.randint(100, 999)} {rng.randint(1000000, 9999999)}",
        "email": lambda: f"{rng.choice('abc')}{rng.randint(0, 10**6)}@example.org",
        "credential": lambda: f"k{rng.getrandbits(60):x}z",
    }
    values = [(k, make()) for k, make in makers.items() for _ in range(40)]
    rows, plan = [], []
    for i in range(300):
        chosen = rng.sample(values, 3)
        parts = [rng.choice(["clean words, here", "version 4.0", "12 of 300"]) for _ in range(4)]
        rows.append((i, " | ".join([parts[0]] + [x for (k, v), p in zip(chosen, parts[1:]) for x in (f"token={v}" if k == "credential" else v, p)])))
        plan.append((chosen, parts))
    out = {r["doc_id"]: r["text"].split(" | ") for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()}
    names = {}
    for i, (chosen, parts) in enumerate(plan):
        assert out[i][::2] == parts
        for value, new in zip(chosen, out[i][1::2]):
            assert value[1] not in new and names.setdefault(value, new) == new
    assert len(set(names.values())) == len(names)


def test_days_and_strings_are_permuted_whole():
    there = pii.Pseudonyms(b"key")
    days = [(pii.FIRST_DAY + pii.timedelta(k)).isoformat() for k in range(0, pii.DAYS, 1)]
    assert {there.day(d, True) for d in days[::7]} <= set(days) and len({there.day(d, True) for d in days[:4000]}) == 4000
    assert sorted(there.characters(f"{k:03d}", b"t") for k in range(1000)) == [f"{k:03d}" for k in range(1000)]


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"key")
    for n in (2, 10, 257, 1000):
        assert sorted(f.permute(i, n, b"t") for i in range(n)) == list(range(n))
        assert all(f.permute(f.permute(i, n, b"t"), n, b"t", back=True) == i for i in range(n))


def test_pseudonymise_keeps_rows_and_columns(docs, odd):
    for df in (docs, odd, docs.limit(0)):
        out = pii.pseudonymise(df, b"key")
        assert out.count() == df.count()
        assert [c for c in out.columns if not c.startswith("pii_")] == [c for c in df.columns if not c.startswith("pii_")]
    assert odd.sparkSession.createDataFrame([(1, "x@y" * 5000 + "1" * 100_000)], "doc_id long, text string").transform(lambda d: pii.pseudonymise(d, b"k")).count() == 1


# ---- 3 vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    rows = [centres[k % 60] + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.25]) for k in range(500)]
    rows += [rows[0]] * 200 + [rows[0] * 3] * 20  # a large group of copies
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    data += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (905, [1.0, 2.0]), (905, [1.0, 2.0]), (None, [float(x) for x in rows[1]])]
    out = vectors.near_duplicates(spark.createDataFrame([(i, e, 0) for i, e in data], "vec_id long, embedding array<double>, ball int")).collect()
    assert len(out) == len(data)
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    links, group = near.sum(axis=1) - 1, np.arange(len(x))
    while not np.array_equal(new := np.array([group[n].min() for n in near]), group):
        group = new
    got = {r["vec_id"]: r for r in out}
    extra = near[1].astype(int)  # the row with a null id
    assert all((got[i]["component_id"], got[i]["kept"]) == (group[i], group[i] == i) for i in range(len(x)))
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.99 * (links.sum() + extra.sum())
    assert all(got[i]["n_links"] <= links[i] + extra[i] for i in range(len(x)))
    for i in (900, 901, 902, 903, 904):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert got[905]["n_links"] == 1
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("shard", [4096, 150])
def test_vectors_in_divided_shards(spark, monkeypatch, shard):
    """Shards of 150 leaders are divided again, some cut into parts; the links are those of all pairs."""
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "SUBSAMPLE", 100)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(150, 32))
    rows = np.array([centres[k % 150] + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3]) for k in range(1500)])
    out = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    x = rows / np.linalg.norm(rows, axis=1)[:, None]
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum() and links.sum() > 2000


def test_search_is_cheaper_than_all_products():
    """On a full shard of clustered rows the search finds nearly all in range and meets few of the rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 64))
    x = centres[rng.integers(0, 400, 4096)] + rng.normal(size=(4096, 64)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    met = 0

    def in_range(a, b, c):
        nonlocal met
        met += len(a)
        return c >= 0.9

    found = sum(len(a) for a, _ in vectors._search(x, vectors._pruned(x), x, in_range, vectors.BEAM))
    true = int((x @ x.T >= 0.9).sum())
    assert 0.97 * true <= found <= true and met < 0.15 * 4096 * 4096


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# ---- 4 BPE


def test_bpe_against_tiktoken(spark, docs, odd):
    with open(RANKS, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab éß  \n\t'sd1²½!\x1c\xa0漢😀.,") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["ab" * 40_000, " " * 5000 + "x", None, "", "<|endoftext|>"]
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, P.PATTERN).collect()
    for r in out:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == true.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["ids"])
    got = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t in corpus():
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, true.encode_ordinary(t or ""))).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(odd, RANKS, P.PATTERN).count() == 7


# ---- 5 decontamination


def test_decontamination_against_all_windows(spark, docs):
    texts = dict(corpus())
    items = [(k, " ".join((texts[k] or "").split()[3:40])) for k in range(0, 20)] + [(50, None), (51, ""), (52, "two words"), (None, "w1 w2"), (53, (texts[3] or "").upper())]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in texts.items():
        words = decontaminate.tokens(t or "")
        for k, item in items:
            own = decontaminate.tokens(item or "")
            size = min(5, len(own))
            if k is None or not own or len(words) < size:
                continue
            run = lambda x, size=size: [tuple(x[a : a + size]) for a in range(len(x) - size + 1)]
            target, h = Counter(run(own)), run(words)
            width = min(len(run(own)), len(h))
            for a in range(len(h) - width + 1):
                c = Counter(h[a : a + width])
                shared = (c & target).total()
                if shared and shared / (c.total() + target.total() - shared) >= 0.8:
                    want.add((i, k))
                    break
    assert got == want and got
    flagged = decontaminate.flag(docs, spark.createDataFrame([], "item_id long, text string"))
    assert flagged.where(F.size("leaks") > 0).count() == 0 and flagged.count() == docs.count()


def test_decontamination_near_the_threshold_and_in_blocks(spark, monkeypatch):
    """Copies with changed words on both sides of 0.8, in long texts and by blocks of items, against all windows."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([20, 60, 150])))) for k in range(12)]
    rows = []
    for i in range(80):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, max(1, len(copy) // 45 + 1))):
            copy[rng.randrange(len(copy))] = "other"
        rows.append((i, " ".join(rng.choices(words, k=rng.choice([0, 30, 3000])) + copy + rng.choices(words, k=10)), "kept"))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string, leaks string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, text, _ in rows:
        for k, item in items:
            a, b = decontaminate.tokens(text), decontaminate.tokens(item)
            run = lambda x: [tuple(x[j : j + 5]) for j in range(len(x) - 4)]
            target, h = Counter(run(b)), run(a)
            width = min(len(h), target.total())
            for start in range(len(h) - width + 1):
                c = Counter(h[start : start + width])
                shared = (c & target).total()
                if shared / (c.total() + target.total() - shared) >= 0.8:
                    want.add((i, k))
                    break
    for size in (16 << 20, 1500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.leaks(docs, table).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and 20 < len(want) < 80
    assert {(r["doc_id"], r["distance"]) for r in got} == {(r["doc_id"], r["distance"]) for r in decontaminate.leaks(docs.repartition(5), table).collect()}


# ---- 6 WARC


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>" * 4000, "<p>é</p>" * 4000, "", None, "a\r\n\r\nWARC/1.1\r\nb", "x" * 70_000, "漢" * 30_000, "same", "same", "same"]
    rows = [(i, f"http://e.com/{i}\r\n", h) for i, h in enumerate(html)] + [(5, "http://e.com/again", "x" * 70_000), (None, None, "same"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, str(tmp_path / "a"), segment_bytes=16384).collect()
    assert len(got) == len(rows) and all(r["complete"] for r in got)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = Counter()
    for i, _, h in rows:
        raw, best = (h or "").encode(), largest.get(h or "")
        kind = "response" if best is None or i == best else "revisit"
        want[(i, len(raw), warc.base32_sha1(raw), kind, best if kind == "revisit" else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    least = warc.round_trip(pages, str(tmp_path / "b"), min_bytes=5).where("record_type = 'revisit'").collect()
    assert {r["page_id"] for r in least} == {0}
    empty = warc.round_trip(pages.limit(0), str(tmp_path / "c"))
    assert empty.count() == 0


def test_warc_foreign_and_damaged_archives(spark, tmp_path):
    """Garbage is passed over; records cut off, and segments with other copies, are incomplete; the rest is read."""
    html = ["a" * 9000, "b" * 9000, "c" * 9000, "small"]
    records = [list(warc.records(i, f"http://e.com/{i}", h.encode(), None, 4096)) for i, h in enumerate(html)]
    changed = records[1][1].replace("bbbb", "bxbb", 1)
    whole = "\r\n\r\n".join(["junk before", *records[0], *records[1], changed, "WARC/1.1\r\nno: length\r\n\r\nx", records[3][0], *records[2]])
    (tmp_path / "x.warc").write_text(whole[:-50], newline="")  # the last segment of the third is cut off
    for _ in range(2):
        got = {r["page_id"]: (r["complete"], r["payload"] and bytes(r["payload"]).decode()) for r in warc.read(spark, str(tmp_path), files="*.warc").collect()}
        assert got == {0: (True, html[0]), 1: (False, None), 2: (False, None), 3: (True, "small")}
    assert list(warc.parse(b"nothing")) == [] and list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")) == [({"content-length": "9"}, None)]


def test_warc_broken_framing():
    assert warc.unchunked(warc.chunked("é漢".encode() * 5000)) == "é漢".encode() * 5000
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


# ---- 7 HTML


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, all of them, always, everywhere.</p></div><div id="main-content"><h2>Head  &amp;
    line</h2><p>First, long enough, with commas, a paragraph <b>bold<br>new</b>.<p>Short.<form><p>field</p></form><script>var x="</p>";</script><div class="ad">Buy, buy, buy, buy.</div>
    <ul><li>one<li>two</ul></div><section id="comments"><p>Nice, really, very, very, very, very, very nice, I must say, truly.</p></section><aside><p>side, side, side</p></aside><footer>&copy; f</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst, long enough, with commas, a paragraph bold new.\nShort.\none\ntwo"
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, None, "<p>" * 50_000, "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert len(got) == 5 and sum(r["n_chars"] > 0 for r in got) == 2
    assert html_text.extract(rows.limit(0)).count() == 0


def test_main_text_in_wrappers_and_beside_the_best_container():
    long = "A paragraph, long enough, with commas, of the article, that goes on, and on, for some time, until its end."
    for before, after in (("<form id=aspnetForm>", "</form>"), ("<div id=wrapper class='right-sidebar'>", "</div>"), ("<div class='page-header-fixed'><form>", "</form></div>"), ("<nav><ul><li>Menu", "")):
        for tag in ("article", "main", "div"):
            if tag != "div" or "nav" not in before:
                page = f"<body>{before}<nav><a href=/>Menu</a></nav><{tag}><p>{long}</p><p>{long}</p></{tag}><div class=sidebar><p>Side.</p></div>{after}<footer>f</footer>"
                assert html_text.main_text(page) == f"{long}\n{long}", page
    assert html_text.main_text("<div class='cookie-notice'><p>We use cookies, always.</p></div>") == ""
    page = f"<body><div><div><p>{long}</p><p>{long}</p></div><ul><li>one<li>two</ul>bare text<blockquote>said</blockquote><table><tr><td>cell</table><section><p>The end.</p></section><ul><li><a href=/>More</a></ul><a href=/>link</a></div>"
    assert html_text.main_text(page) == f"{long}\n{long}\none\ntwo\nbare text\nsaid\ncell\nThe end."


P1 = "The first paragraph, long enough, with commas, says what the page is about, and goes on, for a while, until its end."
P2 = "The second paragraph, as long, with as many commas, adds what the first left out, and then, at last, ends as well."
#: Page shapes and the text that a reader would call the article.
SHAPES = {
    "inline adverts": (f"<article><p>{P1} <span class='ad'>BUY NOW</span></p><p>{P2}<span hidden> no</span><i style='display: none'>no</i></p><p><span class=note>yes</span></p></article>", [P1, P2, "yes"]),
    "inline block in an advert": (f"<article><p>{P1}</p><span class=ad-slot>Buy <b>now</b><div>or <span>never</span></div></span><p>{P2}</article>", [P1, P2]),
    "divisions only": (f"<body><div id=top-nav><a href=/>Home</a></div><div id=post><div class=title><h1>Title</h1></div><div class=body><div><p>{P1}</p></div><div><p>{P2}</p><p>Short.</p><pre>x = 1\n y</pre><table><tr><td>a<td>b</table></div></div></div><div class=site-footer>f</div>", ["Title", P1, P2, "Short.", "x = 1 y", "a", "b"]),
    "beside the paragraphs": (f"<body><div><pre>code here</pre><div><p>{P1}</p><p>{P2}</p></div><p>Short.</p><table><tr><th>h<td>c</table></div>", ["code here", P1, P2, "Short.", "h", "c"]),
    "names that only look like marks": (f"<body><div class='social-science'><div class='tags-python related-work'><p>{P1}</p><p id=follow-through>{P2}</p><p class='print skip-logic'>Short.</p></div></div><div class=social-links><a href=/>f</a></div><footer>f</footer>", [P1, P2, "Short."]),
    "a weak mark on the article": (f"<body><div class=related><p>{P1}</p><p>{P2}</p><p>{P1}</p></div><div class=related><ul><li><a href=/>More</a><li><a href=/>And more</a></ul></div><div class=share>Share this</div>", [P1, P2, P1]),
    "overflow is not hidden": (f"<main class='overflow-hidden no-sidebar'><h2 class=entry-header>Head</h2><p>{P1}</p><div class=hidden>no</div><p>{P2}</p></main>", ["Head", P1, P2]),
    "lists, quotes and definitions": (f"<article><p>{P1}<ul><li>one<li>two<ul><li>three</ul></ul><blockquote><p>{P2}</blockquote><dl><dt>t<dd>d</dl><hr>end</article>", [P1, "one", "two", "three", P2, "t", "d", "end"]),
    "comments and forms": (f"<body><div class=post><p>{P1}</p><p>{P2}</p></div><div id=comments-area><h3>2 comments</h3><div class=comment-body><p>{P1}</p></div><div class=comment-body><p>{P2}</p></div></div><form><p>{P1}</p></form>", [P1, P2]),
    "code with comments": (f"<article><p>{P1}</p><pre><span class='hljs-comment'># why</span> x <span class='token comment'>; so</span></pre><p>{P2}</p></article>", [P1, "# why x ; so", P2]),
    "references and entities": (f"<article><h1>A &amp; B &lt;c&gt; &#8212; &eacute;&nbsp;d</h1><p>{P1}</p><p>{P2}</p><ol><li><a href=/>A source</a></ol></article>", ["A & B <c> \u2014 \u00e9 d", P1, P2, "A source"]),
    "sidebars of any name": (f"<body><div class=acme-sidebar><p>{P1}</p></div><div id=leftNav><p>x, y, z</p></div><div class='cookie-bar'>{P2}</div><section><h2>H</h2><p>{P1}</p><p>{P2}</p></section><div class='widget-area'>w</div><div class=ad-300x250>b</div>", ["H", P1, P2]),
    "bare text": (f"<body>{P1}<br>on<hr>{P2}", [f"{P1} on", P2]),
    "broken markup": (f"<body><div class=menu><ul><li><a href=/>x</a></div><article><p>{P1}<p>{P2}</b></i></div><p>more<!-- <p>no</p> --></article><footer>f", [P1, P2, "more"]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_main_text_of_page_shapes(shape):
    page, want = SHAPES[shape]
    assert html_text.main_text(page) == "\n".join(want)


def test_nesting_has_no_depth_limit():
    deep = 700
    page = "<div>" * deep + f"<nav><a href=/>Menu</a> words, here</nav><form><p>field</p></form><p>{P1}</p><div class=sidebar><p>side</p></div><p>{P2}</p>" + "</div>" * deep + "<footer>f</footer>"
    assert html_text.main_text(page) == f"{P1}\n{P2}"
    import time

    start = time.perf_counter()
    for part in ("<div>", "<div>a, b ", "<div class=sidebar>a", "<div class=sidebar><p class=menu>a</p>", "<ul><li>a", "<p>", "<span class=ad>", "<b>a", "<table><tr><td>a", "<form>a<article>"):
        html_text.main_text(part * 40_000)
    assert time.perf_counter() - start < 60  # linear: some seconds


# ---- 8 toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad, good = ["grubble", "snorf", "blechy", "vexilno", "vexilta"], [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(900):
        words, toxic = rng.choices(good, k=rng.randint(5, 80)), i % 6 == 0
        if toxic:
            for w in rng.choices(bad, k=rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), w.upper() if rng.random() < 0.3 else w)
        rows.append((i, " ".join(words), "x"))
        if i < 600:
            labels.append((i, int(toxic), None))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (1000, "", "x")], "doc_id long, text string, p_toxic string")
    table = spark.createDataFrame([*labels, (None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.classify(docs, table.select("doc_id", "toxic")).collect()}
    held = [(got[i], i % 6 == 0) for i in range(600, 900)]
    assert sum(a and b for a, b in held) >= 0.95 * sum(b for _, b in held) and not any(a and not b for a, b in held)
    assert got[None] is False and got[1000] is False
    assert toxicity.classify(docs, table.limit(0)).where("is_toxic").count() == 0
    assert toxicity.classify(docs.limit(0), table).count() == 0


# ---- 9 SimHash


def plain_fingerprint(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(docs):
    rows = {i: plain_fingerprint(t) for i, t in corpus()}
    group = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i in rows:
            low = min(group[j] for j in rows if (rows[i] ^ rows[j]).bit_count() <= 3)
            if low < group[i]:
                group[i], changed = low, True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", group[i]) for i, f in rows.items()}


def test_pigeonring_loses_no_pair(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for x in base]
    crowd = [base[0] ^ np.uint64(int(a) << 3) for a in rng.integers(0, 2**12, 400)]  # a bucket above the small ones
    values = np.unique(np.array([*base, *near, *crowd], np.uint64))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long"))
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    apart = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    root = np.arange(len(values))
    while not np.array_equal(new := np.array([root[a].min() for a in apart]), root):
        root = new
    signed = values.view(np.int64).tolist()
    groups = Counter(root.tolist())
    for k, x in enumerate(signed):
        assert (groups[root[k]] > 1) == (x in got)
        if x in got:
            assert got[x] == min(signed[j] for j in np.flatnonzero(root == root[k]))


def test_chains_prune_before_the_distance(monkeypatch):
    """The first chain beyond the key is counted for all pairs of a bucket, later chains and the distance for what is left."""
    fp = np.random.default_rng(4).integers(0, 2**44, 600, dtype=np.uint64)
    fp[300:] = fp[:300] ^ np.uint64(5)
    count, counted = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(x.size) or count(x))
    found = {frozenset(x) for b in simhash._bucket_links(np.zeros(600, np.int64), fp, 3, 4) for x in zip(*b.to_pydict().values(), strict=True)}
    assert found == {frozenset(x) for x in zip(fp[:300].tolist(), fp[300:].tolist(), strict=True)}
    assert counted[0] == 600 * 600 and sum(counted[1:]) < 0.01 * counted[0]


@pytest.mark.parametrize("crowd", [0, 40])
def test_links_are_pairs_within_the_distance(crowd):
    fp = np.array([0, 0b111, 0b111111, *((k + 1) << 34 for k in range(crowd))], np.uint64)
    found = [x for b in simhash._bucket_links(np.zeros(len(fp), np.int64), fp, 3, 4) for x in zip(*b.to_pydict().values(), strict=True)]
    assert all((u ^ v).bit_count() <= 3 for u, v in found)
    assert {frozenset(x) for x in found} >= {frozenset((0, 7)), frozenset((7, 63))}


def test_representatives(docs, odd):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(range(120, 130)).isdisjoint(ids)  # exact copies go, their first stays
    assert sorted(str(r["doc_id"]) for r in simhash.representatives(odd).collect()) == ["1", "2", "None"]


def test_representatives_of_extended_copies(spark):
    rng = random.Random(3)
    base = [[f"w{rng.random()}" for _ in range(100)] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, *(f"n{rng.random()}" for _ in range(22))]) for b in base]  # 96 of 118 shingles
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.representatives(docs).collect()} == set(range(20))


def near_copies(seed=11):
    """Texts cut, extended or changed to similarities on both sides of 0.8, half by words that stand nowhere else."""
    rng = random.Random(seed)
    texts = []
    for k in range(60):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([30, 80, 300]))]
        texts.append(" ".join(base))
        for _ in range(5):
            changed, part = list(base), rng.uniform(0.02, 0.35)
            kind = rng.randint(0, 3)
            if kind == 0:
                changed += [f"n{k}x{rng.random()}" for _ in range(int(part * len(base)))]
            elif kind == 1:
                del changed[: int(part * len(base))]
            else:
                for at in rng.sample(range(len(base)), max(1, int(part * len(base) / 5))):
                    changed[at] = f"n{rng.random()}" if kind == 2 else base[0]
            texts.append(" ".join(changed))
    return texts


def five_words(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def firsts(texts):
    """Positions of the first text of each group of all pairs at 0.8 or more."""
    group, sets = list(range(len(texts))), [five_words(t) for t in texts]
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if group[i] != group[j] and len(a & b) >= 0.8 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return {i for i, g in enumerate(group) if g == i}


@pytest.mark.parametrize("few", [64, 2])
def test_representatives_of_near_copies_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "SAMPLE", 2)  # an order with frequent shingles last finds the same
    monkeypatch.setattr(simhash, "FREQUENT", 4)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.representatives(docs).collect()}
    assert got == firsts(texts) and len(texts) / 4 < len(got) < len(texts)
