"""The whole pipeline against a version of it that is written from the definitions alone, over a small fixture."""

import collections
import random
import re
import zlib

import pytest

from plumbline.llm import langid

from .test_native_operators import WS, brute_mix
from .test_text_operators import SAID, brute_classes, brute_lines, brute_scan, plain_language

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Words string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIP = " \t\n\x0b\x0c\r"
ITEMS = [(1, "Which of the following rivers flows through the largest number of European capitals on its way to the sea"), (2, "an item of five words"), (3, None)]
SHARED = "this line of more than forty characters stands in every second document"


def fixture_rows():
    """Clean documents of three languages and sources, with copies, near copies, shared lines, leaks and what has no language."""
    rnd = random.Random(12)
    rows = []
    for i in range(90):
        lang = list(SAID)[i % 3]
        words = SAID[lang].split()
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(6, 14))) for _ in range(rnd.randint(2, 5))]
        if i % 2:
            lines.insert(rnd.randrange(len(lines)), rnd.choice([SHARED, f"  {SHARED.upper()}\t"]))
        rows.append([i, "\n".join(lines), lang, f"s{i % 4}"])
    for k in range(12):  # copies and near copies
        words = rows[k][1].split(" ")
        if k % 2:
            words[rnd.randrange(len(words))] = "changed"
        rows.append([200 + k, " ".join(words), rows[k][2], rows[k][3]])
    text = " ".join(rnd.choice(SAID["en"].split()) for _ in range(60))
    rows.append([300, f"{text} {ITEMS[0][1].upper()}, {text[::-1]}", "en", "s1"])
    rows.append([301, f"{ITEMS[0][1]} and more", "en", "s1"])  # mostly a leak: it goes
    rows.append([302, f"{text[:150]} an item, of five; words {text[150:]} the end", "en", "s2"])
    rows += [[400, None, "en", "s1"], [401, "", "en", "s1"], [402, "12 34 !!", "de", None], [403, "привет мир", None, "s1"], [404, "½ ² Ⅷ", "fr", "s2"]]
    return rows


def brute_language(rows):
    """Rows whose language is known with a score of a half at least."""
    counts, docs = collections.Counter(), collections.Counter()
    for i, t, lang, _ in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            docs[lang] += 1
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                if not w.isalpha():
                    continue
                counts[lang, 0, w] += 1
                for n in range(1, langid.MAX_GRAM + 1):
                    for g in list(w) if n == 1 else [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]:
                        counts[lang, n, g] += 1
    out = []
    for r in rows:
        letters = r[1] and any(c.isalpha() for c in r[1])
        lang, score = plain_language(r[1], counts, docs) if letters else ("und", 0.0)
        if lang != "und" and score >= langid.MIN_SCORE:
            assert score > 0.51, "the fixture has no text on the edge"
            out.append(r)
    return out


def brute_line_texts(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(STRIP))
    holders = collections.defaultdict(set)
    for i, t, _, _ in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    dropped = {r[0]: r[2] for r in brute_lines([(i, t) for i, t, _, _ in rows])}
    out = []
    for i, t, lang, s in rows:
        keep = [x for x in t.split("\n") if not (len(holders.get(key(x), ())) >= 5 and i < max(holders[key(x)]))]
        assert len(t.split("\n")) - len(keep) == dropped[i]
        out.append([i, "\n".join(keep), lang, s])
    return out


def brute_near(rows):
    classes = brute_classes([(r[0], r[1]) for r in rows])
    return [r for r in rows if classes[r[0]] == r[0]]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_clean(rows):
    """Hit words go, from the first to the last of each run of them, with what is between; texts mostly hit go as a whole."""
    out = []
    for i, t, lang, s in rows:
        n, hit, _ = brute_scan(t, [x for x in ITEMS if x[1]])
        if n and hit > 0.5 * n:
            continue
        while hit:
            low = lower(t)
            spans = [m.span() for m in re.finditer(WORD, low)]
            words = [low[a:b] for a, b in spans]
            bad = set()
            for _, item in ITEMS:
                w = re.findall(WORD, lower(item or ""))
                for win in [w[k : k + min(10, len(w))] for k in range(max(1, len(w) - 9))] if w else []:
                    for p in range(len(words) - len(win) + 1):
                        if words[p : p + len(win)] == win:
                            bad |= set(range(p, p + len(win)))
            runs = []
            for k in sorted(bad):
                if runs and runs[-1][1] == k - 1:
                    runs[-1][1] = k
                else:
                    runs.append([k, k])
            for a, b in reversed(runs):
                t = t[: spans[a][0]] + t[spans[b][1] :]
            hit = brute_scan(t, [x for x in ITEMS if x[1]])[1]
        out.append([i, t, lang, s])
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows and texts, and what the mix takes, are those of the plain version."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = fixture_rows()
    d = str(tmp_path)
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "w") for r in rows], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{d}/documents.parquet"), rows
    plain = [brute_language, brute_line_texts, brute_near, brute_clean]
    for k, ((name, stage), rule) in enumerate(zip(corpus_pipeline.STAGES[:-1], plain, strict=True)):
        before, want = want, rule(want)
        assert name == ["language_id", "line_dedup", "near_dedup", "decontamination"][k]
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        got = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect())
        assert got == sorted((i, t, lang, s, len(t)) for i, t, lang, s in want), name
        assert want != before, f"the fixture gives {name} something to do"
    _, taken, rank = brute_mix([(i, t, lang, s) for i, t, lang, s in want])
    source = {i: s for i, _, _, s in want}
    sums, texts = collections.Counter(), {i: t for i, t, _, _ in want}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, d).collect():
        assert r.text == texts[r.doc_id]
        sums[rank[source[r.doc_id]], r.doc_id] += len(re.findall(WS, r.text))
    assert sums == +taken
