"""Each stage of the pipeline, and the whole, on small tables: odd rows, clashing columns, brute-force versions."""

import hashlib
import random
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pagemill.llm import bpe, decontaminate, graph, pii, queries, simhash
from pagemill.session import Scratch

from .test_operators import firsts, five_words, near_copies

GOOD, BAD = [f"g{chr(97 + k % 26)}{chr(97 + k // 26)}ood" for k in range(300)], ["grubble", "snorf", "blechy"]
OWN = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "p_toxic double, p_dense string, leaks string, pii_email long, PII_card string, __hash long, __h long, row string, node long, `a.b` string, shard int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the texts by id."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(GOOD, k=rng.randint(30, 90))) for _ in range(240)]
    for i in range(0, 240, 5):
        texts[i] += " " + " ".join(rng.choices(BAD, k=5))
    items = [" ".join(rng.choices(GOOD, k=25)) for _ in range(4)]
    for i, item in zip((11, 12, 13), items, strict=False):
        texts[i] += " " + item
    texts += [texts[1], texts[1], texts[2] + " tail", "mail me at someone@example.com or +49 170 1234567", "", None, None, " ".join(GOOD * 40)]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, OWN).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def odd(spark):
    text = " ".join(GOOD[:40])
    rows = [(5, text), (5, text), (5, None), (None, text), (None, "other"), (1, text + " end"), (2, ""), (3, " ".join(GOOD * 100)), (6, "snorf grubble blechy snorf")]
    return spark.createDataFrame([(i, t, "en", "s", 3, 0.9, "d", "l", 7, "c", 1, 2, "r", 4, "dot", 8) for i, t in rows], f"{OWN}, {CLASH}")


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, tables, stage):
    """All columns come through, those with the operators' own names too; rows with odd texts stay."""
    docs, run = odd(spark), pipeline.STAGES[stage][1]
    out = run(spark, docs, tables[0])
    if stage < 4:
        assert out.columns == docs.columns
        got = out.collect()
        assert all((r["p_toxic"], r["leaks"], r["pii_email"], r["PII_card"], r["__h"], r["row"], r["a.b"]) == (0.9, "l", 7, "c", 2, "r", "dot") for r in got)
        assert len(got) == {0: 8, 1: 5, 2: 9, 3: 9}[stage]
    else:
        assert out.count() == 9
    assert run(spark, docs.limit(0), tables[0]).count() == 0


def test_near_duplicate_stage_against_all_pairs(spark, tables):
    texts = near_copies(21)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], OWN)
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, tables[0]).collect()} == firsts(texts)


def test_near_duplicate_stage_links_by_the_pigeonring(spark, tables, monkeypatch):
    """Without the prefix filter's candidates, what is left are the links of SimHash fingerprints, judged by the sets."""
    rng = random.Random(8)
    pairs = []
    for k in range(40):
        base = [f"w{rng.random()}" for _ in range(400)]
        pairs.append((" ".join(base), " ".join([*base[: 400 - 20 * (k % 10)], f"end{k}"])))
    texts = [t for pair in pairs for t in pair]
    prints = []
    for t in texts:
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in five_words(t)]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    close = {2 * k + 1 for k in range(40) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 3}
    alike = set(range(80)) - firsts(texts)
    near = close & alike
    assert near and near < alike
    monkeypatch.setattr(simhash, "_candidates", lambda rows, rule, near: rows.sparkSession.createDataFrame([], "u long, v long"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], OWN)
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, tables[0]).collect()} == set(range(80)) - near


def test_near_duplicate_stage_leaves_no_tables_of_its_steps(spark, tables, monkeypatch):
    """Three checkpoints stay, of the sets, the rows of the buckets and the first rows; all else goes with the step, failed ones too."""
    texts, shared = near_copies(21), Path(spark.conf.get("spark.checkpoint.dir"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], OWN)

    def there():
        return {p for p in shared.rglob("*") if p.is_dir() and p.name.startswith(("rdd-", "pagemill-scratch-"))}

    before = there()
    out = pipeline.near_duplicates(spark, docs, tables[0])
    made = there() - before
    assert len(made) <= 3 and all(p.name.startswith("rdd-") for p in made)
    assert {r["doc_id"] for r in out.collect()} == firsts(texts)

    def broken(*_):
        raise ValueError("no candidates")

    monkeypatch.setattr(simhash, "_candidates", broken)
    with pytest.raises(ValueError, match="no candidates"):
        pipeline.near_duplicates(spark, docs, tables[0])
    assert not [p for p in there() if p.name.startswith("pagemill-scratch-")]


def test_components_in_a_scratch_folder(spark):
    """The same components as by checkpoints; a table with a successor is gone, and so is all with the folder."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 90), (95, 100), (7, 7)], "u long, v long")
    with Scratch(spark) as keep:
        kept = graph.components(edges, keep=keep)
        assert len(list(Path(keep.folder).iterdir())) == 4  # graph, jump, on, names
        got = {r["node"]: r["component"] for r in kept.collect()}
        none = graph.components(edges.where("u = 7 and v = 7"), keep=keep)
        assert none.collect() == []
    assert got == {**dict.fromkeys(range(61), 0), 90: 90, 95: 90, 100: 90} == {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert not Path(keep.folder).exists()


def test_whole_pipeline(spark, tables):
    folder, texts, items = tables
    out = {r["doc_id"]: r for r in pipeline.run(spark, folder).collect()}
    clean = [i for i, t in enumerate(texts) if not (i < 240 and i % 5 == 0)]
    clean = [i for i in clean if i in {clean[k] for k in firsts([texts[i] or "" for i in clean])}]
    clean = [i for i in clean if not any(item in (texts[i] or "") for item in items)]
    assert set(out) == set(clean)
    with open(queries.RANKS, "rb") as f:
        true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    names = pii.Pseudonyms(queries.PII_KEY)
    for i in clean:
        text = names.replace(texts[i] or "")[0]
        assert out[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, true.encode_ordinary(text))).encode()).hexdigest()


def test_registered_queries_have_their_contract_columns(spark, tables):
    folder, texts, items = tables
    every = queries.queries()
    rows = {r["doc_id"]: r for r in every["op1_substrings"](spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        if t and not rows[i]["n_removed"]:
            assert rows[i]["kept_sha256"] == hashlib.sha256(" ".join(t.split()).encode()).hexdigest() and rows[i]["n_words"] == len(t.split())
    assert rows[240]["n_removed"] == len(texts[1].split()) and rows[240]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    rows = {r["doc_id"]: r for r in every["op10_passages"](spark, folder).collect()}
    assert (rows[240]["n_removed"], rows[240]["n_spans"], rows[240]["kept_sha256"]) == (len(texts[1]), 1, hashlib.sha256(b"").hexdigest())
    assert {(r["doc_id"], r["item_id"]) for r in every["op5_decontaminate"](spark, folder).collect()} == {(11, 0), (12, 1), (13, 2)}
    assert every["op8_toxicity"](spark, folder).where(F.col("is_toxic") != (F.col("doc_id") % 5 == 0)).where("doc_id < 240").count() == 0
    assert every["op4_bpe"](spark, folder).columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert every["op2_pii"](spark, folder).where("pii_email = 1 and pii_phone = 1").count() == 1
    assert decontaminate.leaks(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 3
