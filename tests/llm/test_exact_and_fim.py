"""Exact dedup by content sort and fill-in-the-middle, against brute force and at their edges."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import content_sort, fim
from plumbline.llm.shared import setting

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, Part int, sha string, Whole string"
WHITE = re.compile(r"[\x20\x09-\x0D]+")
LONG = "a passage that many texts begin with, longer than what a splitter holds, "


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 3, "x", "w") for i, t in texts], DOCS)


def hard_texts():
    """Nulls, empty and very long texts, ties, repeated rows, a text that a third of all rows share, and near misses."""
    rnd = random.Random(4)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, " "), (5, "one"), (5, "one"), (5, "one\n"), (None, "one"), (None, "alone"), (None, "alone"), (None, None), (6, "word " * 60_000), (7, "word \n" * 60_000), (8, "word " * 60_000 + "x"), (9, "é😀<P>"), (10, "a\x00b"), (11, "a\x00 b")]
    texts += [(100 + i, LONG + "hot") for i in range(60)]
    texts += [(200 + i, LONG + rnd.choice("abcde") * rnd.randint(1, 3) + rnd.choice([" ", "\t\n", "  "]) + "end") for i in range(80)]
    texts += [(-(2**63), LONG + "hot"), (2**63 - 1, LONG + "hot"), (None, LONG + "hot")]
    rnd.shuffle(texts)
    return texts


def key(i):
    return (1, 0) if i is None else (0, i)


def brute_groups(texts):
    norm = [(i, WHITE.sub(" ", t or "")) for i, t in texts]
    held = collections.defaultdict(list)
    for i, t in norm:
        held[t].append(i)
    first = {t: min(ids, key=key) for t, ids in held.items()}
    stays, out = set(), []
    for i, t in norm:
        kept = i == first[t] and t not in stays
        stays |= {t} if kept else set()
        out.append((key(i), key(first[t]), len(held[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("ranges", [None, 1, 2, 40])
def test_content_groups(spark, ranges):
    texts = hard_texts()
    got = content_sort.groups(docs_of(spark, texts).repartition(5), ranges).collect()
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == brute_groups(texts)


def test_content_ranges_split_a_hot_text(spark):
    """The copies of one text fill several ranges, each smaller than the group, and are still one group."""
    docs = docs_of(spark, [(i, LONG) for i in range(400)] + [(1000 + i, f"text {i}") for i in range(100)]).repartition(4)
    rows = content_sort.runs(docs, 20)
    sizes = [r["count"] for r in rows.where(F.col("sha") == hashlib.sha256(LONG.encode()).hexdigest()).groupBy("part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 120
    got = content_sort.groups(docs, 20).where("group_size > 1").agg(F.count("*").alias("n"), F.min("group_size").alias("size"), F.sum(F.col("kept").cast("int")).alias("kept"), F.max("keep_id").alias("keep")).first()
    assert (got.n, got["size"], got.kept, got.keep) == (400, 400, 1, 0)


def test_content_neighbours_are_compared_in_full(spark, monkeypatch):
    """With a digest that never differs, whole texts still tell the rows of a range apart."""
    texts = [(i, f"text {i % 7}") for i in range(50)]
    monkeypatch.setattr(content_sort.F, "sha2", lambda col, bits: F.lit("same"))
    monkeypatch.setattr(content_sort, "HEAD", 2)
    got = content_sort.groups(docs_of(spark, texts), 1).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(i, i % 7) for i in range(50)]


def test_content_dedup_keeps_columns(spark):
    texts = hard_texts()
    docs = docs_of(spark, texts)
    out = content_sort.dedup_exact(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((key(r.doc_id), hashlib.sha256(WHITE.sub(" ", r.text or "").encode()).hexdigest()) for r in got) == sorted((r[0], r[4]) for r in brute_groups(texts) if r[3])
    assert {(r.row, r.Part, r.sha, r.Whole) for r in got} == {("r", 3, "x", "w")}
    assert any(r.text is None or r.text == "" for r in got)
    assert content_sort.groups(docs.limit(0)).count() == 0 and content_sort.dedup_exact(docs.limit(0)).count() == 0


def test_content_texts_are_shuffled_once(spark):
    docs = docs_of(spark, hard_texts())
    plan = content_sort.runs(docs)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# ---- fill-in-the-middle


def brute_fim(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("text", ["", "a", "abc", "é", "a b", "  ", "one two, three\n" * 50, "x" * 5000, ".!?" * 999, "Ab1" * 700 + "é😀" * 9])
def test_elias_fano(text):
    ends = fim.boundaries(text)
    assert ends.tolist() == list(np.cumsum([len(u) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text)]).astype(int))
    coded = fim.encode(ends)
    read = fim.Boundaries(coded)
    assert read.n == len(ends) and [read[i] for i in range(len(ends))] == ends.tolist() and read.after(0) == 0
    assert len(coded) <= 16 + len(ends) * (2 + max(0, np.log2(max(len(text), 1) / max(len(ends), 1)))) / 8 + 1


@pytest.mark.parametrize("size", [1, 2, 63, 1000])
def test_elias_fano_wide_gaps(size):
    rnd = np.random.default_rng(size)
    ends = np.cumsum(rnd.integers(1, 5000, size))
    read = fim.Boundaries(fim.encode(ends))
    assert [read[i] for i in range(size)] == ends.tolist()


def test_fim_round_trip_of_marks_at_edges():
    for text in ("<", "<<P", "P>", "<S", "<M<P<S", "a<P b>S> c<M"):
        for doc in range(200):
            out, form, _, _ = fim.formatted(text, fim.Boundaries(fim.encode(fim.boundaries(text))), doc)
            assert fim.restored(out, form) == text


def test_fim_report(spark):
    texts = hard_texts() + [(300 + i, f"Words of text {i}, with <S> in some" if i % 5 == 0 else f"Words, of text {i}.\n") for i in range(60)]
    got = fim.report(docs_of(spark, texts).repartition(5)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(key(i), n, form, str(p), str(m), sha(out), sha(t or "")) for i, t in texts for n, form, p, m, out in [brute_fim(i, t)]]
    assert sorted((key(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256) for r in got) == sorted(want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.report(docs_of(spark, texts).limit(0)).count() == 0


def test_fim_index_has_each_text_once(spark):
    texts = hard_texts()
    rows = fim.text_index(docs_of(spark, texts).repartition(5)).collect()
    assert sorted(r.text for r in rows) == sorted({t or "" for _, t in texts})


def test_fim_makes_a_list_once_for_a_run_of_documents():
    entries = fim.Entries()
    for raw in (b"a b", b"a b", b"a b", b"c", b"c"):
        text, ends = entries.of(raw)
        assert text == raw.decode() and ends.n == brute_fim(0, text)[0]
    assert entries.made == 2


def test_fim_documents_join_texts_where_they_are(spark):
    """Texts are shuffled once: what is above their exchange keeps its dealing."""
    docs = docs_of(spark, hard_texts()).select("doc_id", "text")
    met = fim.with_entries(docs, "sha", "whole")
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    cool = plan.split("Union")[1].split("SortMergeJoin")[1]
    assert cool.count("Exchange hashpartitioning") == 2


def test_fim_ends_where_two_texts_have_one_digest(spark, monkeypatch):
    monkeypatch.setattr(fim, "digest", lambda text: F.lit("same"))
    with pytest.raises(Exception, match="different texts have the digest"):
        fim.text_index(docs_of(spark, [(1, "a"), (2, "b")])).collect()


def test_fim_deals_hot_texts(spark):
    """A text with more documents than a fair share comes in several copies, each for its slot of documents."""
    docs = docs_of(spark, [(i, "hot text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(500)])
    met = fim.with_entries(docs.select("doc_id", "text"), "sha", "t")
    assert met.count() == 3500 and met.select("doc_id").distinct().count() == 3500
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        sizes = [r["count"] for r in met.where("t = 'hot text'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2900


def test_fim_keeps_columns(spark):
    texts = hard_texts()
    docs = docs_of(spark, texts).withColumn("FIM_N", F.lit(5))
    out = fim.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "_fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars"]
    got = out.collect()
    assert sorted((key(r.doc_id), r.text, r._fim_n, r.fim_form) for r in got) == sorted((key(i), out, n, form) for i, t in texts for n, form, _, _, out in [brute_fim(i, t)])
    assert {(r.Part, r.sha, r.Whole, r.FIM_N, r.row) for r in got} == {(3, "x", "w", 5, "r")}
