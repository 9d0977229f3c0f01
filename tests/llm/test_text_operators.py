"""Decontamination, line dedup, near-dedup, language ID and LM scoring against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from plumbline.llm import dart_minhash, decontaminate, langid, line_dedup, pitman_yor

DOCS = "doc_id long, text string, lang string, source string, n_chars long, raw string, Gone int"
LONG = "a line that is long enough to take part in line dedup"


def docs_of(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), "r", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "no id at all"), (None, None), (6, "word " * 30_000), (4, "one")]


# ---- decontamination


def windows_of(words, window):
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)] if len(words) >= window else [tuple(words)] if words else []


def brute_scan(text, items, window=10):
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pat, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for name, item in items:
        for w in windows_of(low(item), window):
            for p in range(len(words) - len(w) + 1):
                if tuple(words[p : p + len(w)]) == w:
                    hit |= set(range(p, p + len(w)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_automaton_against_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        vocab = [b"a", b"b", b"c", b"d"][: rnd.randint(1, 4)]
        window = rnd.randint(1, 4)
        items = [(str(i), [rnd.choice(vocab) for _ in range(rnd.randint(1, 8))]) for i in range(rnd.randint(1, 5))]
        doc = [rnd.choice([*vocab, b"z"]) for _ in range(rnd.randint(0, 25))]
        spans, found, _ = decontaminate.ItemAutomaton(items, window).match(doc)
        hit, want = set(), set()
        for k, (_, ws) in enumerate(items):
            for w in windows_of(ws, window):
                for p in range(len(doc) - len(w) + 1):
                    if tuple(doc[p : p + len(w)]) == w:
                        hit |= set(range(p, p + len(w)))
                        want.add(k)
        assert {x for a, b in spans for x in range(a, b)} == hit and found == want


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(10, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short Ítem"), (2, None), (None, "one"), (3, ""), (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    return spark.createDataFrame(rows, "item_id long, text string")


LEAK = "x y ALPHA, beta-gamma delta epsilon (zeta) eta theta iota kappa; tail short Ítem."


def test_decontamination(spark, bench):
    texts = [*EDGES, (20, LEAK), (21, "alpha beta gamma"), (22, "short Ítem"), (23, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    items = [(r[0], r[1]) for r in bench.collect() if r[0] is not None]
    want = sorted((i if i is not None else -1, *brute_scan(t, items)[:2], hashlib.sha256(",".join(brute_scan(t, items)[2]).encode()).hexdigest()) for i, t in texts)
    for blocks in (decontaminate.BLOCK_WORDS, 3):  # one automaton, and several in turn
        got = decontaminate.scan(docs_of(spark, texts), bench, block_words=blocks).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got) == want
    report = {r.doc_id: r for r in decontaminate.report(docs_of(spark, texts), bench).collect()}
    assert report[20].n_items == 3 and report[20].contaminated and not report[21].contaminated


def test_decontamination_removes_spans(spark, bench):
    out = decontaminate.decontaminate(docs_of(spark, [(1, "clean text stays"), (2, LEAK + " and many other words that nobody ever put into a test"), (3, LEAK), (4, None)]), bench)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert texts[1] == "clean text stays" and texts[4] is None and 3 not in texts
    assert texts[2].startswith("x y ") and "kappa" not in texts[2] and "Ítem" not in texts[2] and texts[2].endswith("into a test")
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    none = bench.where("false")
    assert decontaminate.decontaminate(docs_of(spark, EDGES), none).count() == len(EDGES)


# ---- line dedup


def brute_lines(texts, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holders = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) >= min_docs and i < max(holders[key(x)]))]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def line_texts():
    rnd = random.Random(5)
    pool = [LONG, LONG.upper() + "  ", "\t" + LONG, "é" * 40, "é" * 39, "short", "", "x" * 40, *(f"line number {i} that only some of the documents hold" for i in range(8))]
    return [*EDGES, *((100 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(40))]


@pytest.mark.parametrize(("batches", "fanout"), [(4, 4), (7, 2), (1, 2)])
def test_line_dedup(spark, batches, fanout):
    texts = line_texts()
    docs = docs_of(spark, texts)
    gone = line_dedup.drops(docs, batches=batches, fanout=fanout)
    assert gone.count() == len({r[0] for r in brute_lines(texts) if r[2]})
    got = line_dedup.report(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines(texts)


def test_line_dedup_stage_and_runs(spark):
    texts = [(i, f"{LONG}\nown line of document {i}, which is long as well") for i in range(6)]
    out = line_dedup.dedup_lines(docs_of(spark, [*texts, (9, None)]))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == "own line of document 0, which is long as well" and got[5] == texts[5][1] and got[9] is None
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    runs = line_dedup.Runs(spark, fanout=2)
    keys = line_dedup.line_keys(docs_of(spark, texts))
    runs.add(keys)
    assert runs.unseen(keys).count() == 0
    assert runs.unseen(line_dedup.line_keys(docs_of(spark, [(50, LONG + " with a new end")]))).count() == 1
    runs.drop()


def test_line_runs_batch_by_batch(spark):
    """Of each batch the anti-join leaves what no earlier batch had; runs are merged level by level, and read in place."""
    rnd = random.Random(3)
    pool = [f"line number {i} of the pool, which is long enough to count" for i in range(60)]
    runs, had, held = line_dedup.Runs(spark, fanout=3), set(), collections.defaultdict(set)
    for batch in range(7):
        texts = [(100 - batch * 10 + i, "\n".join(rnd.sample(pool, 4))) for i in range(3)]
        for i, t in texts:
            for line in t.split("\n"):
                held[line].add(i)
        keys = line_dedup.line_keys(docs_of(spark, texts)).distinct()
        mine = {line for _, t in texts for line in t.split("\n")}
        if batch:
            distinct = keys.select("h1", "h2").distinct()
            assert runs.unseen(distinct).count() == len(mine - had)
            assert runs.seen(distinct).count() == len(mine & had)
        runs.add(keys)
        had |= mine
    assert runs.compactions == 2 and [len(level) for level in runs.levels] == [1, 2]
    with runs.in_place():
        plan = runs.merged(runs.all())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    got = sorted((r.n_docs, r.keeper) for r in runs.compacted().collect())
    assert got == sorted((len(v), max(v)) for v in held.values())
    runs.drop()


def test_line_keepers_come_from_the_anti_join(spark, monkeypatch):
    """Batches fall by id, so the first batch to have a key keeps it; without the anti-join a later batch would."""
    texts = [(i, f"{LONG}\nown line of document {i}, which is long as well") for i in range(40)]
    kept = lambda: sorted(i for i in range(40) if i not in {r.doc_id for r in line_dedup.drops(docs_of(spark, texts)).collect()})
    assert kept() == [39]
    monkeypatch.setattr(line_dedup.Runs, "unseen", lambda self, keys: keys)
    assert kept() != [39]


def test_line_batches_by_falling_ids(spark):
    docs = docs_of(spark, [(i, "x") for i in range(100)])
    got = {r.doc_id: r.batch for r in docs.withColumn("batch", line_dedup.falling_ranges(docs, 4)).collect()}
    assert got[99] == 0 and got[0] == 3 and all(got[i] >= got[i + 1] for i in range(99))
    same = docs_of(spark, [(7, "x")] * 10 + [(None, "y")])
    assert {r.batch for r in same.where("doc_id = 7").withColumn("batch", line_dedup.falling_ranges(same, 4)).collect()} == {0}
    assert empty(spark).withColumn("batch", line_dedup.falling_ranges(empty(spark), 4)).count() == 0


# ---- near-dedup


def brute_classes(texts):
    hashes = dart_minhash.WordHashes()
    cells = {i: collections.Counter() for i, _ in texts}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        cells[i] = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else collections.Counter()
    root = {i: i for i in cells}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(cells)
    for a in ids:
        for b in ids:
            if a < b and cells[a] and cells[b]:
                both = sum((cells[a] & cells[b]).values())
                if both >= 0.8 * sum((cells[a] | cells[b]).values()):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    assert hashes is not None
    return {i: find(i) for i in ids}


def near_texts():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    out = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 6])):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
    base = [word() for _ in range(150)]  # a large group whose members are linked by others only
    for _ in range(80):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5])):
            w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    return [(i, t) for i, t in enumerate([*out, "a a a a a a a a", "a a a a a a a a a", "", " ", None, "Same Words here", "same  words\nHERE"])]


def test_near_dedup_against_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(docs_of(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_near_dedup_edges(spark):
    rows = dart_minhash.classes(docs_of(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[None] == {None} and by[5] == {4} and by[1] == {1} and by[2] == {2}
    assert dart_minhash.classes(empty(spark)).count() == 0
    kept = dart_minhash.keep_one(docs_of(spark, [(7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (8, None)]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 8)]
    assert kept.columns[-1] == "Gone"


def test_near_dedup_repeated_ids_and_rows(spark):
    """One row of a class stays, whatever is repeated; texts that share an id are judged each by its words."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    a2, b2 = a + " end", b + " end"
    texts = [(1, a), (1, a), (2, a), (1, b), (7, b2), (9, a2), (None, c), (None, c), (None, a), (None, None), (5, ""), (5, " ")]
    docs = docs_of(spark, texts)
    got = collections.Counter((r.doc_id, r.class_id) for r in dart_minhash.classes(docs).collect())
    assert got == collections.Counter([(1, 1)] * 3 + [(2, 1), (7, 1), (9, 1)] + [(None, None)] * 4 + [(5, 5)] * 2)
    kept = sorted((r.doc_id or 0, r.text or "") for r in dart_minhash.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b), (0, c), (0, ""), (5, ""), (5, " ")])
    again = sorted((r.doc_id or 0, r.text or "") for r in dart_minhash.keep_one(docs.repartition(3)).collect())
    assert again == kept


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    base = [b"w%d" % i for i in rng.integers(0, 30, 600)]  # many repeated shingles would not show with sets
    other = base[:540] + [b"x%d" % i for i in range(60)]
    h = dart_minhash.WordHashes()
    a, b = dart_minhash.shingle_cells(base, h), dart_minhash.shingle_cells(other, h)
    s = dart_minhash.signatures([a, b])
    both = len(np.intersect1d(a, b))
    assert abs((s[0] == s[1]).mean() - both / (len(a) + len(b) - both)) < 0.12
    alone = dart_minhash.signatures([b])
    assert (alone[0] == s[1]).all()  # whatever it is thrown with


# ---- language ID

SAID = {
    "en": "the house and the garden of my father were never far from that river where we played with other children",
    "de": "das haus und der garten meines vaters waren nie weit von dem fluss an dem wir mit anderen kindern spielten",
    "fr": "la maison et le jardin de mon père ne furent jamais loin de cette rivière où nous jouions avec d'autres enfants",
}


def test_language_id(spark):
    rnd = random.Random(1)
    texts, langs = [], {}
    for i in range(90):
        lang = list(SAID)[i % 3]
        words = SAID[lang].split()
        texts.append((i, " ".join(rnd.choice(words) for _ in range(12))))
        langs[i] = lang
    odd = [(200, None), (201, ""), (202, "123 ... 456"), (203, "Häuser gärten flüsse"), (None, "the river of my father"), (200, None), (204, "the river " * 50_000)]
    docs = docs_of(spark, [*texts, *odd], langs | {203: None})
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert all(got[i].lang_pred == langs[i] for i in langs)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in langs)
    assert [(got[i].lang_pred, got[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203].lang_pred == "de" and got[204].lang_pred == "en" and 0 < got[204].score <= 1
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*langs, 203, 204, None}
    assert langid.report(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.report(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}


def test_language_id_backs_off_to_shorter_grams():
    m = langid.Model([("a", 0, "known", 3), ("b", 0, "other", 3), ("a", 3, "^kn", 5), ("b", 3, "zzz", 5), ("b", 1, "z", 9), ("a", 1, "k", 9)], {"a": 1, "b": 1}, 3)
    scores, known = m.of_words(["known", "knight", "uz", "ééé"])
    assert known.tolist() == [True, True, True, False]
    assert scores[:3].argmax(1).tolist() == [0, 0, 1]
    assert m.texts(["привет мир", None, "..."], langid.Known(m)) == [("a", 0.0), ("und", 0.0), ("und", 0.0)]


def test_language_words_are_letters():
    """A word's characters are those of the categories L, each code point tried alone and between letters."""
    for c in map(chr, [*range(0x3000), *range(0x1F100, 0x1F200)]):
        letter = unicodedata.category(c).startswith("L")
        if c == c.lower():
            assert langid.words(c) == ([c] if letter else [])
            if not unicodedata.category(c).startswith("M"):
                assert langid.words(f"a{c}b") == ([f"a{c}b"] if letter else ["a", "b"])
    assert langid.words("½ ² Ⅷ 5 ٣") == [] and langid.words("x² über_das") == ["x", "über", "das"]


def test_language_of_a_text_of_numbers_is_und(spark):
    docs = docs_of(spark, [*((i, f"words of text {i}") for i in range(20)), (900, "½ ² Ⅷ"), (901, "words²")])
    got = {r.doc_id: r.lang_pred for r in langid.report(docs).collect()}
    assert got[900] == "und" and got[901] == "en"


def test_language_sample_is_bounded_by_characters(spark):
    """Where texts are long, fewer of them are sampled; every language stays."""
    texts = [(i, ("common words " if i % 2 else "andere wörter ") * (50 if i % 10 else 2000)) for i in range(400)]
    docs = docs_of(spark, texts, {i: "en" if i % 2 else "de" for i, _ in texts})
    whole = langid.train(docs)
    some = langid.train(docs, max_train_chars=100_000)
    assert whole.langs == some.langs == ["de", "en"] and all(set(some.rows[n]) <= set(whole.rows[n]) for n in range(langid.MAX_GRAM + 1))
    assert [lang for lang, _ in some.texts(["common words", "andere wörter"], langid.Known(some))] == ["en", "de"]


def plain_language(text, counts, docs, max_gram=langid.MAX_GRAM):
    """Language and score by the definition, word by word."""
    langs = sorted(docs)
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not found or not langs:
        return "und", 0.0
    tables = {n: collections.defaultdict(dict) for n in range(max_gram + 1)}
    totals = collections.Counter()
    for (lang, n, key), c in counts.items():
        tables[n][key][lang] = c
        totals[lang, n] += c
    logp = lambda lang, n, key: math.log(tables[n][key].get(lang, 0) + 0.5) - math.log(totals[lang, n] + 0.5 * (len(tables[n]) + 1))
    sums, known = dict.fromkeys(langs, 0.0), 0
    for w in found:
        for n in (0, *range(max_gram, 0, -1)):
            pieces = [w] if n == 0 else list(w) if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
            if hit := [x for x in pieces if x in tables[n]]:
                known += 1
                for lang in langs:
                    sums[lang] += sum(logp(lang, n, x) for x in hit) / len(hit)
                break
    prior = {lang: math.log(docs[lang] / sum(docs.values())) for lang in langs}
    if not known:
        return max(langs, key=lambda x: (prior[x], -langs.index(x))), 0.0
    score = {lang: sums[lang] / known * min(known, langid.SHARP) + prior[lang] for lang in langs}
    total = sum(math.exp(v - max(score.values())) for v in score.values())
    return max(langs, key=lambda x: score[x]), 1 / total


def test_language_id_against_plain_scorer(spark):
    """The whole operator against a scorer that is written from the definition alone."""
    rnd = random.Random(8)
    texts, langs = [], {}
    for i in range(120):
        lang = rnd.choice(list(SAID))
        mixed = SAID[lang].split() + rnd.choice(list(SAID.values())).split()[:3]
        texts.append((i, " ".join(rnd.choice(mixed)[: rnd.randint(2, 9)] + rnd.choice(["", "", "x", "ß"]) for _ in range(rnd.randint(1, 20)))))
        langs[i] = lang if rnd.random() < 0.9 else None
    odd = [(300, "река"), (301, "qqq zzz"), (302, None), (303, "7 8")]
    texts, langs = texts + odd, langs | {i: None for i, _ in odd}
    texts.append((309, " ".join(rnd.choice(SAID["en"].split()) for _ in range(1500))))
    langs[309] = "en"
    counts, docs = collections.Counter(), collections.Counter()
    for i, t in texts:
        if langs.get(i) and zlib.crc32(str(i).encode()) % 3 != 1:
            docs[langs[i]] += 1
            found = re.findall(r"[^\W\d_]+", t.lower())
            for w, often in collections.Counter(found).items():  # a text of more than 1,000 words weighs as one of 1,000
                weight = max(1, round(1024 * often * min(1, 1000 / len(found)))) / 1024
                counts[langs[i], 0, w] += weight
                for n in range(1, langid.MAX_GRAM + 1):
                    for g in list(w) if n == 1 else [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]:
                        counts[langs[i], n, g] += weight
    for r in langid.report(docs_of(spark, texts, langs)).collect():
        lang, score = plain_language(dict(texts)[r.doc_id], counts, docs)
        assert r.score == pytest.approx(score, abs=2e-4)
        assert r.lang_pred == lang or score < 0.51


def test_language_sample_is_dealt_evenly():
    assert langid.shares({"a": 10, "b": 1000, "c": 2000}, 410) == {"a": 1.0, "b": 0.2, "c": 0.1}
    assert langid.shares({"a": 5, "b": 5}, 100) == {"a": 1.0, "b": 1.0}


# ---- LM scoring


def lm_texts():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(150):
        at, t = rnd.randrange(40), []
        for _ in range(rnd.randint(0, 40)):
            t.append(words[at])
            at = (at * 7 + rnd.choice([1, 2])) % 40
        out.append((i, " ".join(t)))
    return [*out, (900, None), (901, ""), (902, "NEW w1  New\x0bw2"), (None, "w1 w2"), (900, None)]


@pytest.mark.parametrize(("chunk", "shard"), [(pitman_yor.CHUNK_TOKENS, pitman_yor.SHARD_TOKENS), (200, 40)])
def test_lm_scores(spark, chunk, shard):
    texts = lm_texts()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    from pyspark.sql import functions as F

    got = pitman_yor.score_texts(docs_of(spark, texts), F.expr(f"not ({pitman_yor.HELD_OUT})"), chunk, shard).collect()
    assert len(got) == len(texts)
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.doc_id].append(r)
    base = model = 0.0
    for i, t in texts:
        r = rows[i][0]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        assert r.trained != held(i) and r.train_tokens == n and r.n_tokens == len(tokens(t)) and r.n_known == sum(counts[w] > 0 for w in tokens(t))
        assert r.base_score == pytest.approx(want) and r.score < 0
        if held(i):
            base, model = base + want, model + r.score
    assert model > 0.8 * base  # the order of words tells much here


def test_lm_is_reproducible(spark):
    from pyspark.sql import functions as F

    runs = [sorted((r.doc_id or -1, r.score) for r in pitman_yor.score_texts(docs_of(spark, lm_texts()), F.col("doc_id") % 3 > 0, 500, 400).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and all(math.isfinite(s) and s <= 0 for _, s in runs[0])


def test_lm_without_training_or_rows(spark):
    from pyspark.sql import functions as F

    got = pitman_yor.score_texts(docs_of(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)} and all(r.score == 0 for r in got)
    assert pitman_yor.score_texts(empty(spark), F.lit(True)).count() == 0


def test_seating_moves_keep_customers():
    rng = np.random.default_rng(0)
    count = np.array([2, 3, 50, 7])
    t = pitman_yor.Tables(np.arange(4), np.ones(4, np.int64), 4)
    t.reseat(np.arange(4), pitman_yor.first_tables(count, np.full(4, 0.7), 0.5, rng), count)
    for _ in range(200):
        t.take(np.arange(4), rng)
        t.seat(np.arange(4), np.full(4, 0.7), 0.5, rng)
        assert (t.customers == count).all() and (np.bincount(t.dish, t.size, 4) == count).all() and (np.bincount(t.dish, minlength=4) == t.tables).all() and (t.size > 0).all()


def test_gibbs_moves_sample_the_posterior():
    """Two customers of one dish: odds of one table are (1 - d) to new."""
    rng = np.random.default_rng(1)
    n, d, new = 20_000, 0.4, 1.2
    t = pitman_yor.Tables(np.arange(n), np.full(n, 2), n)
    for _ in range(3):
        t.take(np.arange(n), rng)
        t.seat(np.arange(n), np.full(n, new), d, rng)
    assert abs((t.tables == 1).mean() - (1 - d) / (1 - d + new)) < 0.02


def chunk_of(texts, trained):
    """A chunk as the operator makes it, without Spark."""
    coder, parts = pitman_yor.Coder(), []
    first = coder[pitman_yor.BEFORE]
    for text in texts:
        parts.append(np.array([coder[w] for w in [*text.encode().split(), pitman_yor.END]], np.uint32))
    vocab = np.array([pitman_yor.xxhash.xxh3_64_intdigest(w) for w in coder], np.uint64)
    return {"chunk": 0, "rows": list(range(len(texts))), "doc_ids": list(range(len(texts))), "trained": trained, "sizes": [len(p) for p in parts], "before": np.full((len(texts), 2), first, np.uint32).tobytes(), "vocab": vocab.tobytes(), "tokens": pitman_yor.packed(np.concatenate(parts))}


def lm_numbers(chunk, homes=1):
    """Numbers and counts of the chunk's words, and the sums that homes give with them."""
    asked = collections.defaultdict(list)
    for r in pitman_yor.spelling(chunk, homes):
        asked[r["home"]].append(r)
    told = [r for rows in asked.values() for r in pitman_yor.numbers(rows, homes, 1e9)]
    sums = [s for r in told for s in r.get("sums") or ()]
    return *pitman_yor.known(chunk, [{"ids": None} | r for r in told], homes), sums


def lm_state(texts, trained, layout, model=None, sweeps=3, seed=0, split=(), split_pairs=()):
    """All shards after some sweeps, seated against homes that were asked once; split: contexts, as texts."""
    chunk = chunk_of(texts, trained)
    ids, _, counted = lm_numbers(chunk, layout.homes)
    words = {}
    for text in texts:
        for w in ["", *text.split(), "\n"]:
            words[w] = None
    vocab = np.frombuffer(chunk["vocab"], np.uint64)
    at = {int(h): int(i) for h, i in zip(vocab, ids, strict=True)}
    words = {w: at[pitman_yor.xxhash.xxh3_64_intdigest(w.encode())] for w in words}
    pair = {int(pitman_yor.pair_key(words[u], words[v])): n for (u, v), n in dict(split_pairs).items()}
    layout = pitman_yor.Layout(layout.shards, layout.homes, {words[w]: n for w, n in dict(split).items()}, pair)
    sent, rows, asked = collections.defaultdict(list), [], collections.defaultdict(list)
    for r in pitman_yor.letters(chunk, ids, layout):
        sent[r["shard"]].append(r)
    for letters in sent.values():
        rows += pitman_yor.merged_rows(letters, layout)
    bodies = collections.defaultdict(list)
    for r in rows:
        bodies[r["shard"]].append(r)
        if "home" in r:
            asked[r["home"]].append(r)
    told, sums = collections.defaultdict(list), collections.Counter()
    for questions in asked.values():
        for r in pitman_yor.home_answers(questions, None):
            told[r["shard"]].append(r)
    for s in [*counted, *(s for r in [*rows, *told.pop(-1)] for s in r.get("sums") or ())]:
        sums[s["what"], s["key"], 0] += s["first"]
        sums[s["what"], s["key"], 1] += s["second"]
    both = lambda what, k=0: (sums[what, k, 0], sums[what, k, 1])
    if model is None:
        model = pitman_yor.Model({1: 0.5, 2: 0.5, 3: 0.5}, {1: 1.0, 2: 1.0, 3: 1.0})
    model.vocabulary, model.trained = (int(x) for x in both(pitman_yor.SIZES))
    model.root_tables, model.root_customers = both(pitman_yor.ROOT)
    model.split = np.array([both(pitman_yor.SPLIT, k) for k in range(len(layout.words))]).reshape(-1, 2)
    model.split_pairs = np.array([both(pitman_yor.SPLIT_PAIR, k) for k in range(len(layout.pairs))]).reshape(-1, 2)
    shards = []
    for number, body in bodies.items():
        s, rng = pitman_yor.Shard.of_rows(body, layout), np.random.default_rng([seed, number])
        s.hear(told[number], model)
        s.begin(rng)
        for _ in range(sweeps):
            s.sweep(rng)
        kept = s.state()
        again = pitman_yor.Shard.of_rows(body, layout)
        again.hear(told[number], model)
        again.resume(kept)
        assert (again.tables() == s.tables()).all() and (again.parent_tables() == s.parent_tables()).all() and (again.parent.size == s.parent.size).all()
        assert (np.where(s.a_apart, 0, s._came()) == s.parent.customers).all()
        shards.append((s, rng))
    return pitman_yor.Triples(chunk, ids, layout), shards, {v: k for k, v in words.items()}


@pytest.mark.parametrize("split", [False, True])
def test_lm_is_a_distribution(split):
    """After any context the probabilities of all words and of an unknown one sum to 1, with contexts split or whole."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    train = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 15))) for _ in range(60)]
    asked = [f"{a} {b} {w}" for a, b in (("w0", "w1"), ("w5", "w2"), ("w7", "w7"), ("zz", "w1")) for w in [*words, "unknown"]] + [f"{a} {b}" for a, b in (("w0", "w1"), ("w5", "w2"), ("w7", "w7"), ("zz", "w1"))]
    some, pairs = ({"w1": 2, "w2": 3}, {("w0", "w1"): 2}) if split else ({}, {})
    t, shards, _ = lm_state(train + asked, [True] * 60 + [False] * len(asked), pitman_yor.Layout(4, 2), split=some, split_pairs=pairs)
    p = np.zeros(len(t.w))
    by_shard = {s.row["shard"]: s for s, _ in shards}
    for number, at in t.of_shard():
        s = by_shard[number]
        place = np.cumsum(pitman_yor.unpacked(s.row["places"], np.int32), dtype=np.int64)
        p[at] = s.predictive()[place]
    first = np.cumsum(t.sizes) - t.sizes
    for k in range(4):
        texts = [60 + 13 * k + i for i in range(13)]
        at = [t.triple[first[i] + 2] for i in texts] + [t.triple[first[60 + 52 + k] + 2]]
        # Split contexts go by totals as they were told; the rest is exact.
        assert p[at].sum() == pytest.approx(1, abs=0.1 if split else 1e-9)


def brute_sampler(texts, words, d, theta, sweeps, rng):
    """One customer at a time through three levels of restaurants, with tables as lists; mean probability of each (u, v, w)."""
    base = 1 / (words + 1)
    rooms = collections.defaultdict(lambda: collections.defaultdict(list))
    level = lambda c: len(c) + 1

    def prob(c, w):
        parent = prob(c[1:], w) if c else base
        room, k = rooms[c], level(c)
        n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        mine = room.get(w, [])
        return (sum(mine) - d[k] * len(mine) + (theta[k] + d[k] * t) * parent) / (theta[k] + n)

    def add(c, w):
        room, k = rooms[c], level(c)
        tables = room[w]
        t = sum(map(len, room.values()))
        parent = prob(c[1:], w) if c else base
        weights = [n - d[k] for n in tables] + [(theta[k] + d[k] * t) * parent]
        at = rng.choices(range(len(weights)), weights)[0]
        if at == len(tables):
            tables.append(1)
            if c:
                add(c[1:], w)
        else:
            tables[at] += 1

    def remove(c, w):
        tables = rooms[c][w]
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            if c:
                remove(c[1:], w)

    customers = []
    for text in texts:
        before = ("", "")
        for w in [*text.split(), "\n"]:
            customers.append((before, w))
            before = (before[1], w)
    for c, w in customers:
        add(c, w)
    sums, kept = collections.Counter(), sweeps - sweeps // 4
    tables = {2: 0.0, 3: 0.0}
    for k in range(sweeps):
        for c, w in customers:
            remove(c, w)
            add(c, w)
        if k >= sweeps // 4:
            for c, w in set(customers):
                sums[c, w] += prob(c, w) / kept
            for n in tables:
                tables[n] += sum(len(t) for c, room in rooms.items() if level(c) == n for t in room.values()) / kept
    return sums, tables


def lm_means(texts, layout, model, burn, sweeps):
    """Mean probability of each (u, v, w) and mean tables of the second and third level over sweeps of the one shard."""
    t, shards, names = lm_state(texts, [True] * len(texts), layout, model, sweeps=burn)
    s, rng = shards[0]
    p, tables = np.zeros(len(s.count)), {2: 0.0, 3: 0.0}
    for _ in range(sweeps):
        s.sweep(rng)
        p += s.predictive() / sweeps
        tables[2] += s.parent_tables().sum() / sweeps
        tables[3] += s.tables().sum() / sweeps
    place = np.cumsum(pitman_yor.unpacked(s.row["places"], np.int32), dtype=np.int64)
    return {((names[u], names[v]), names[w]): p[place[k]] for k, (u, v, w) in enumerate(zip(t.u.tolist(), t.v.tolist(), t.w.tolist(), strict=True))}, tables


def test_lm_against_a_brute_force_sampler():
    """Mean probabilities are those of a sampler that moves one customer at a time."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(8)]
    texts = [" ".join(rnd.choice(words[: rnd.choice([2, 4, 8])]) for _ in range(rnd.randint(2, 8))) for _ in range(40)]
    layout = pitman_yor.Layout(1)
    d, theta = {1: 0.4, 2: 0.5, 3: 0.6}, {1: 1.0, 2: 0.8, 3: 0.6}
    want, _ = brute_sampler(texts, 9, d, theta, 160, random.Random(1))
    got, _ = lm_means(texts, layout, pitman_yor.Model(d, theta), 10, 120)
    assert got.keys() == want.keys()
    logs = [(math.log(got[k]), math.log(want[k])) for k in want]
    assert abs(sum(a - b for a, b in logs) / len(logs)) < 0.03
    assert sum(abs(a - b) for a, b in logs) / len(logs) < 0.08


@pytest.mark.parametrize("seed", [0, 1])
def test_lm_has_as_many_tables_as_a_brute_force_sampler(seed):
    """Weights that vary with what is taken out: sixty contexts of two words, whose words come 2, 2, 3 or 5 times."""
    rnd = random.Random(seed)
    texts = [f"u{c} v{c % 20} {w}" for c in range(60) for w, n in zip(rnd.sample([f"w{k}" for k in range(30)], 4), (2, 2, 3, 5), strict=True) for _ in range(n)]
    words = len({w for t in texts for w in t.split()}) + 1
    d, theta = {1: 0.5, 2: 0.5, 3: 0.7}, {1: 1.0, 2: 0.5, 3: 0.2}
    want, tables = brute_sampler(texts, words, d, theta, 80, random.Random(1))
    got, mine = lm_means(texts, pitman_yor.Layout(1), pitman_yor.Model(d, theta), 20, 200)
    assert mine[3] == pytest.approx(tables[3], rel=0.02) and mine[2] == pytest.approx(tables[2], rel=0.03)
    logs = [math.log(got[k]) - math.log(want[k]) for k in want]
    assert abs(sum(logs) / len(logs)) < 0.02


def test_homes_draw_tables_of_the_posterior():
    """Words with three customers at the root: odds of one, two and three tables are as the model has them."""
    n, d = 4000, 0.6
    model = pitman_yor.Model({1: d, 2: 0.5, 3: 0.5}, {1: 1.0, 2: 1.0, 3: 1.0}, n, 3 * n, 1.4 * n, 3.0 * n)
    none = pitman_yor.packed(np.empty(0, np.int64))
    row = {"shard": 0, "home": 0, "asked": pitman_yor.packed(np.diff(np.arange(n), prepend=0).astype(np.uint32)), "customers": pitman_yor.packed(np.full(n, 3)), "split_at": pitman_yor.packed(np.empty(0, np.uint32)), "split_of": pitman_yor.packed(np.empty(0, np.uint32)), "split_customers": none}
    answer = pitman_yor.home_answers([row], model)[0]
    w = model.opening(1, model.root_tables) * model.base
    odds = np.array([w * (1 - d) * (2 - d), 3 * w**2 * (1 - d), w**3])
    want = (odds * [1, 2, 3]).sum() / odds.sum()
    assert pitman_yor.unpacked(answer["tables"], np.uint32).mean() / pitman_yor.SAMPLES == pytest.approx(want, rel=0.03)


def test_long_texts_are_pieces(spark):
    """A text over many chunks scores as one row, and as it does in one piece but for the order of draws."""
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    texts = [(1, " ".join(f"w{rnd.randrange(30)}" for _ in range(3000))), (2, "w1 w2"), (3, "")]
    one, many = ({r.doc_id: r for r in pitman_yor.score_texts(docs_of(spark, texts), F.lit(True), size).collect()} for size in (pitman_yor.CHUNK_TOKENS, 170))
    for i in (1, 2, 3):
        assert (many[i].n_tokens, many[i].n_known, many[i].train_tokens) == (one[i].n_tokens, one[i].n_known, one[i].train_tokens)
        assert many[i].base_score == pytest.approx(one[i].base_score) and many[i].score == pytest.approx(one[i].score, rel=0.02)


def test_a_sweep_moves_a_share_of_all_customers():
    rng, n = np.random.default_rng(2), 5000
    t = pitman_yor.Tables(np.zeros(1, np.int64), np.array([n]), 1)
    t.stir(lambda dishes, gone: np.full(len(dishes), 1e15), 0.3, rng)  # who moves, opens a table
    assert t.customers[0] == t.size.sum() == n and n / 2 < t.tables[0] == len(t.size)


def test_crowds_sample_the_posterior():
    """100 customers, more than ROUNDS: odds of t tables are a generalised Stirling number times new ** t."""
    rng, n, dishes, new, d = np.random.default_rng(2), 100, np.arange(1000), 30.0, 0.3
    ways = np.zeros(n + 2)
    ways[1] = 1.0
    for c in range(1, n):
        ways = ways * np.maximum(c - d * np.arange(n + 2), 0) + np.append(0, ways[:-1])
        ways /= ways.sum()
    odds = ways * new ** np.arange(n + 2)
    want = (odds * np.arange(n + 2)).sum() / odds.sum()
    t = pitman_yor.Tables(dishes, np.ones(1000, np.int64), 1000)
    t.reseat(dishes, pitman_yor.first_tables(np.full(1000, n), np.full(1000, new), d, rng), np.full(1000, n))
    for _ in range(15):
        t.stir(lambda some, gone: np.full(len(some), new), d, rng)
    assert (t.customers == n).all() and t.tables.mean() == pytest.approx(want, rel=0.04)


def test_batches_are_merged_against_the_runs(spark):
    """Each key has its keeper in one run, that of the batch that brought it; what later batches add is counted."""
    batches = [[(7, "a"), (6, "b")], [(5, "a"), (4, "c")], [(3, "a"), (2, "c"), (1, "d")]]
    for fanout, n_runs in ((4, 3), (2, 2)):
        runs = line_dedup.Runs(spark, fanout)
        for rows in batches:
            runs.add(spark.createDataFrame([(ord(k), 0, i) for i, k in rows], "h1 long, h2 long, doc_id long"))
        keepers = collections.Counter(chr(r.h1) for run in runs.all() for r in run.where("keeper is not null").collect())
        assert len(runs.all()) == n_runs and keepers == {"a": 1, "b": 1, "c": 1, "d": 1}
        assert {(chr(r.h1), r.n_docs, r.keeper) for r in runs.compacted().collect()} == {("a", 3, 7), ("b", 1, 6), ("c", 2, 4), ("d", 1, 1)}
        runs.drop()
