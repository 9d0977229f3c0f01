"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Of every whole text, counts are taken (words, their characters, symbols, repeated lines, words in repeated 5-word
windows). A text with fewer than 10 words or with more than 20 % of its words in repeated windows fails the base rule.
The others' transformed statistic vectors are compared with their language and source by a minimum covariance
determinant estimate: from three starts (medians with quartile ranges, all texts, directions from the median),
concentration steps take the ``SUBSET`` of the texts that are nearest by the estimate so far and estimate anew from them,
until no determinant falls any more; the start with the least determinant wins. A text whose squared Mahalanobis
distance passes ``cutoff`` is rejected. Ranks go by counts in fixed bins (of e^(1/BINS) of squared distance; a subset takes whole bins), so
that results depend neither on the order of rows nor on how they are dealt.

A language and source with fewer than ``min_group`` texts are judged by the estimate of their language, one with fewer
by that of all texts. To every variance a floor is added, so a statistic that most texts share exactly does not make
the scatter singular; statistics are bounded below only on their harmless side by the same distance.

Edge cases: null and blank texts have no words and fail the base rule; null languages and sources are groups of their
own; repeated rows count and are judged alike; without rows there are none; when every text fails the base rule no
estimate is needed; extra columns pass through ``keep_typical``, whose own columns avoid their names.

Scale: each text is read once and its counts are written; concentration steps aggregate those rows, with map-side
combine, to counts of bins, whose number does not grow with the texts, and a few numbers a group. Only groups that judge a
text are estimated. Texts meet the few models of their group by a join on the group: where Spark does not broadcast the
models, a hot group's rows of numbers (not texts) are in one task unless AQE splits it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import WHITE_CHARS, stash, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SUBSET = 0.75
MAX_STEPS = 12
MIN_GROUP = 50
#: Added to the variances of the vector's five parts, so that each of them alone can reject a text.
FLOORS = (0.04, 0.04, 0.25, 0.01, 0.005)
#: Bins of an e-fold of squared distance, and of 1 of a statistic where quartiles are found.
BINS, GRID = 256, 1024
P = len(FLOORS)


def counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and carry's columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words_of(text).alias("words"), *carry)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    split = split.select("doc_id", "lang", "source", *carry, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"), grams.alias("grams"))
    # Only texts with a repeated window sort theirs: equal neighbours are repeated, and the words they cover are counted.
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.when(repeated, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias("at")))))
    split = split.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("pairs", pairs)
    split = split.withColumn("starts", F.sort_array(F.transform(F.filter("pairs", lambda p, i: F.coalesce(p["gram"] == F.get("pairs", i - 1)["gram"], F.lit(False)) | F.coalesce(p["gram"] == F.get("pairs", i + 1)["gram"], F.lit(False))), lambda p: p["at"])))
    covered = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("past")), lambda acc, at: F.struct((acc["n"] + at + WINDOW - F.greatest(acc["past"], at)).alias("n"), (at + WINDOW).alias("past")), lambda acc: acc["n"])
    split = split.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return split.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *carry)


def vector() -> list[Column]:
    """The transformed statistics of a text with a word; the mean word length of short texts leans on 20 words of 5."""
    n = F.col("n_words").cast("double")
    return [F.log1p(n), F.log((F.col("word_chars") + 100) / (n + 20)) * 3, F.log1p(1000 * F.col("n_symbols") / F.col("word_chars")), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def chi_square_below(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_at(q: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, k) < q else (low, mid)
    return low


#: Makes the scatter of the SUBSET nearest texts that of all, were they normal.
CONSISTENCY = SUBSET / chi_square_below(chi_square_at(SUBSET, P), P + 2)


#: The quantile of the chi-square distribution that one in a million normal texts passes.
CUTOFF = round(chi_square_at(1 - 1e-6, P), 3)

LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def factored(scatter: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The Cholesky factor l_ij of each group's scatter c_ij with floors, and its determinant (det); m_i and carry's columns stay."""
    out = scatter
    for i, j in LOWER:
        s = F.greatest(F.col(f"c_{i}{j}"), F.lit(0.0)) + FLOORS[i] if i == j else F.col(f"c_{i}{j}")
        for k in range(j):
            s = s - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[i] / 10))) if i == j else s / F.col(f"l_{j}{j}"))
    det = F.lit(1.0)
    for i in range(P):
        det = det * F.col(f"l_{i}{i}") * F.col(f"l_{i}{i}")
    return out.select("group", *carry, *[f"m_{i}" for i in range(P)], *[f"l_{i}{j}" for i, j in LOWER], det.alias("det"))


def with_distance(rows: DataFrame, model: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by their group's model, and carry's columns of it; null where the group has none."""
    out = rows.join(model.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group")), "left")
    ys = []
    for i in range(P):  # one column after the other, or each would hold all before it many times
        y = F.col(f"z_{i}") - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}{j}") * F.col(f"y_{j}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}{i}"))
        ys.append(F.col(f"y_{i}") * F.col(f"y_{i}"))
    return out.withColumn("d2", sum(ys[1:], ys[0])).select(*rows.columns, *carry, "d2")


def moments(rows: DataFrame, by: tuple[str, ...], factor: float) -> DataFrame:
    """Means m_i and scatters c_ij of rows by some columns."""
    sums = rows.groupBy(*by).agg(*[F.avg(f"z_{i}").alias(f"m_{i}") for i in range(P)], *[F.avg(F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"s_{i}{j}") for i, j in LOWER])
    return sums.select(*by, *[f"m_{i}" for i in range(P)], *[((F.col(f"s_{i}{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor).alias(f"c_{i}{j}") for i, j in LOWER])


def quartiles(rows: DataFrame) -> DataFrame:
    """q_i_1, q_i_2, q_i_3 of each group: the lower ends of the grid's cells that the quartiles fall into."""
    cells = rows.select("group", F.posexplode(F.array(*[f"z_{i}" for i in range(P)])).alias("part", "z"))
    counted = cells.groupBy("group", "part", F.floor(F.col("z") * GRID).alias("cell")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("group", "part")
    upto = counted.select("*", F.sum("n").over(each.orderBy("cell")).alias("upto"), F.sum("n").over(each).alias("total"))
    said = [F.min(F.when((F.col("part") == i) & (F.col("upto") >= F.col("total") * (k / 4)), F.col("cell") / GRID)).alias(f"q_{i}_{k}") for i in range(P) for k in (1, 2, 3)]
    return upto.groupBy("group").agg(*said)


def starts(rows: DataFrame) -> DataFrame:
    """The first models (group, start, m_i, l_ij, det)."""
    spread = [F.col(f"q_{i}_3") - F.col(f"q_{i}_1") for i in range(P)]
    q = quartiles(rows).select("group", *[F.col(f"q_{i}_2").alias(f"m_{i}") for i in range(P)], *[F.sqrt(F.pow(spread[i] / 1.349, 2) + FLOORS[i]).alias(f"v_{i}") for i in range(P)])
    q, _ = stash(q, "quality-quartiles")
    zero = F.lit(0.0)
    first = q.select("group", F.lit(0).alias("start"), *[f"m_{i}" for i in range(P)], *[(F.pow(f"v_{i}", 2) if i == j else zero).alias(f"c_{i}{j}") for i, j in LOWER])
    second = moments(rows, ("group",), 1.0).withColumn("start", F.lit(1))
    # Directions: what lies far out counts no more than what lies near.
    u = [(F.col(f"z_{i}") - F.col(f"m_{i}")) / F.col(f"v_{i}") for i in range(P)]
    length = sum((x * x for x in u[1:]), u[0] * u[0])
    met = rows.join(q, "group").withColumn("length", length)
    signs = [F.avg(F.when(F.col("length") > 0, u[i] * u[j] / F.col("length")).otherwise(0.0)).alias(f"s_{i}{j}") for i, j in LOWER]
    third = met.groupBy("group").agg(*[F.max(f"m_{i}").alias(f"m_{i}") for i in range(P)], *[F.max(f"v_{i}").alias(f"v_{i}") for i in range(P)], *signs)
    third = third.select("group", F.lit(2).alias("start"), *[f"m_{i}" for i in range(P)], *[(F.col(f"s_{i}{j}") * F.col(f"v_{i}") * F.col(f"v_{j}") * P).alias(f"c_{i}{j}") for i, j in LOWER])
    return factored(first.unionByName(second).unionByName(third), ("start",))


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The model of the SUBSET of each group's texts that are nearest by a model so far."""
    far = with_distance(rows, model, ("start",)).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
    counted = far.groupBy("group", "start", "bin").agg(F.count("*").alias("n"))
    each = Window.partitionBy("group", "start")
    upto = counted.select("*", F.sum("n").over(each.orderBy("bin")).alias("upto"), F.sum("n").over(each).alias("total"))
    cut = upto.where(F.col("upto") >= F.col("total") * SUBSET).groupBy("group", "start").agg(F.min("bin").alias("cut"))
    return factored(moments(far.join(cut, ["group", "start"]).where("bin <= cut"), ("group", "start"), CONSISTENCY), ("start",))


def estimate(rows: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """The model of least determinant for each group of (group, z_0, z_1, ...)."""
    model, _ = stash(starts(rows), "quality-model")
    before = None
    for _ in range(max_steps):
        model, _ = stash(concentrated(rows, model), "quality-model")
        total = model.agg(F.sum(F.log("det"))).first()[0]
        if total is None or before is not None and before - total < 1e-9:
            break
        before = total
    names = [c for c in model.columns if c not in ("group", "start")]
    return model.groupBy("group").agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("best")).select("group", *[F.col(f"best.{c}").alias(c) for c in names])


def group_names() -> list[Column]:
    """Own, language's and common group, apart from each other whatever the names hold."""
    lang, source = F.col("lang"), F.col("source")
    return [F.to_json(F.struct(F.lit(3).alias("n"), lang, source)), F.to_json(F.struct(F.lit(2).alias("n"), lang)), F.to_json(F.struct(F.lit(1).alias("n")))]


def judged(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF, carry: tuple[str, ...] = ()) -> DataFrame:
    """counts() with d2 (null for what fails the base rule) and kept."""
    said, _ = stash(counts(docs, carry), "quality-counts")
    names = group_names()
    fits = said.where("not base_failed").select(*[g.alias(f"g{k}") for k, g in enumerate(names)], *[z.alias(f"z_{i}") for i, z in enumerate(vector())])
    sizes = fits.groupBy("g0", "g1").agg(F.count("*").alias("n"))
    wide = Window.partitionBy("g1")
    pick = F.when(F.col("n") >= min_group, F.col("g0")).when(F.sum("n").over(wide) >= min_group, F.col("g1")).otherwise(names[2])
    told, _ = stash(sizes.select("g0", "g1", pick.alias("group")), "quality-groups")
    # A group's estimate is from all its texts, those that are judged by a group of their own included.
    used = told.select("group").distinct()
    rows = fits.withColumn("group", F.explode(F.array("g0", "g1", names[2]))).join(used, "group", "left_semi").select("group", *[f"z_{i}" for i in range(P)])
    model = estimate(stash(rows, "quality-rows")[0])
    own = said.withColumns({f"z_{i}": F.when(~F.col("base_failed"), z) for i, z in enumerate(vector())}).withColumn("_g0", names[0])
    own = own.join(told.select(F.col("g0").alias("_of"), "group"), F.when(~F.col("base_failed"), F.col("_g0")) == F.col("_of"), "left")
    far = with_distance(own, model)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return far.select(*said.columns, "d2", kept.alias("kept"))


def keep_typical(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that are kept, with all their columns."""
    kept = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}
    given = docs.select("doc_id", "lang", "source", "text", *[F.col(c).alias(k) for c, k in kept.items()])
    out = judged(given, min_group, cutoff, tuple(kept.values())).where("kept")
    return out.select(*[F.col(k).alias(c) for c, k in kept.items()])


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, and d2."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 4).alias("d2"))


def report_sql() -> str:
    """The same in SQL, with the concentration steps written out one after the other."""
    zs, ms = [f"z_{i}" for i in range(P)], [f"m_{i}" for i in range(P)]
    ls = [f"l_{i}{j}" for i, j in LOWER]

    def factor(source: str) -> str:
        """Column by column, from c_ij."""
        out = f"SELECT * FROM {source}"
        for i, j in LOWER:
            s = f"greatest(c_{i}{j}, 0) + {FLOORS[i]}" if i == j else f"c_{i}{j}"
            s += "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j))
            out = f"SELECT *, " + (f"sqrt(greatest({s}, {FLOORS[i] / 10!r}))" if i == j else f"({s}) / l_{j}{j}") + f" AS l_{i}{j} FROM ({out})"
        det = " * ".join(f"l_{i}{i} * l_{i}{i}" for i in range(P))
        return f"SELECT grp, start, {', '.join(ms + ls)}, {det} AS det FROM ({out})"

    def far(rows: str, on: str) -> str:
        out = rows + on
        for i in range(P):
            y = f"z_{i} - m_{i}" + "".join(f" - l_{i}{j} * y_{j}" for j in range(i))
            out = f"SELECT *, ({y}) / l_{i}{i} AS y_{i} FROM ({out})"
        return f"SELECT *, {' + '.join(f'y_{i} * y_{i}' for i in range(P))} AS d2 FROM ({out})"

    def moment(source: str, by: str, more: str, weight: float) -> str:
        cs = ", ".join(f"(avg(z_{i} * z_{j}) - avg(z_{i}) * avg(z_{j})) * {weight!r} AS c_{i}{j}" for i, j in LOWER)
        return f"SELECT {by}{more}, {', '.join(f'avg({z}) AS {m}' for z, m in zip(zs, ms, strict=True))}, {cs} FROM {source} GROUP BY {by}"

    parts = [
        r"""t AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents)""",
        r"""grams AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5))""",
        "again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1) GROUP BY rid)",
        r"""said AS (SELECT t.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM t) t LEFT JOIN again USING (rid))""",
        f"based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM said)",
        """fits AS (SELECT rid, lang, source, ln(1.0 + n_words) AS z_0, ln((word_chars + 100) / (n_words + 20)) * 3 AS z_1, ln(1.0 + 1000 * n_symbols / word_chars) AS z_2, sqrt(n_dup_lines / n_words) AS z_3, sqrt(n_repeat_words / n_words) AS z_4,
  ['3', lang, source] AS g0, ['2', lang] AS g1, ['1'] AS g2 FROM based WHERE NOT base_failed)""",
        f"told AS (SELECT rid, CASE WHEN count(*) OVER (PARTITION BY g0) >= {MIN_GROUP} THEN g0 WHEN count(*) OVER (PARTITION BY g1) >= {MIN_GROUP} THEN g1 ELSE g2 END AS grp FROM fits)",
        f"rws AS (SELECT grp, {', '.join(zs)} FROM (SELECT unnest([g0, g1, g2]) AS grp, {', '.join(zs)} FROM fits) WHERE grp IN (SELECT grp FROM told))",
        f"cells AS (SELECT grp, part, floor(z * {GRID}) AS cell, count(*) AS n FROM (SELECT grp, unnest(range({P})) AS part, unnest([{', '.join(zs)}]) AS z FROM rws) GROUP BY ALL)",
        "upto AS (SELECT *, sum(n) OVER (PARTITION BY grp, part ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY grp, part) AS total FROM cells)",
        "qs AS (SELECT grp, " + ", ".join(f"min(cell / {GRID}) FILTER (part = {i} AND upto >= total * {k / 4}) AS q_{i}_{k}" for i in range(P) for k in (1, 2, 3)) + " FROM upto GROUP BY grp)",
        "q AS (SELECT grp, " + ", ".join(f"q_{i}_2 AS m_{i}, sqrt(pow((q_{i}_3 - q_{i}_1) / 1.349, 2) + {FLOORS[i]}) AS v_{i}" for i in range(P)) + " FROM qs)",
        "u AS (SELECT r.grp, " + ", ".join(f"m_{i}, v_{i}, (z_{i} - m_{i}) / v_{i} AS u_{i}" for i in range(P)) + " FROM rws r JOIN q ON r.grp = q.grp)",
        "us AS (SELECT *, " + " + ".join(f"u_{i} * u_{i}" for i in range(P)) + " AS len FROM u)",
        "sg AS (SELECT grp, 2 AS start, " + ", ".join(f"max(m_{i}) AS m_{i}" for i in range(P)) + ", " + ", ".join(f"avg(CASE WHEN len > 0 THEN u_{i} * u_{j} / len ELSE 0 END) * max(v_{i}) * max(v_{j}) * {P} AS c_{i}{j}" for i, j in LOWER) + " FROM us GROUP BY grp)",
        f"al AS ({moment('rws', 'grp', ', 1 AS start', 1.0)})",
        "md AS (SELECT grp, 0 AS start, " + ", ".join(ms) + ", " + ", ".join(f"v_{i} * v_{i} AS c_{i}{j}" if i == j else f"0.0 AS c_{i}{j}" for i, j in LOWER) + " FROM q)",
        f"s0 AS ({factor('(SELECT * FROM md UNION ALL BY NAME SELECT * FROM al UNION ALL BY NAME SELECT * FROM sg)')})",
    ]
    for k in range(MAX_STEPS):
        parts.append(f"f{k} AS (SELECT *, floor(ln(d2 + 1e-6) * {BINS}) AS bin FROM ({far('SELECT r.*, s.* EXCLUDE (grp) FROM rws r', f' JOIN s{k} s ON r.grp = s.grp')}))")
        parts.append(f"c{k} AS (SELECT grp, start, min(bin) AS cut FROM (SELECT *, sum(n) OVER (PARTITION BY grp, start ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY grp, start) AS total FROM (SELECT grp, start, bin, count(*) AS n FROM f{k} GROUP BY ALL)) WHERE upto >= total * {SUBSET} GROUP BY ALL)")
        parts.append(f"n{k} AS ({moment(f'f{k} JOIN c{k} USING (grp, start) WHERE bin <= cut', 'grp, start', '', CONSISTENCY)})")
        parts.append(f"s{k + 1} AS ({factor(f'n{k}')})")
    parts.append(f"best AS (SELECT * FROM s{MAX_STEPS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY det, start) = 1)")
    parts.append(f"dist AS ({far('SELECT f.rid, f.z_0, f.z_1, f.z_2, f.z_3, f.z_4, b.* FROM fits f JOIN told USING (rid)', ' JOIN best b ON told.grp = b.grp')})")
    withs = ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
    return f"WITH {withs}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept, round(d2, 4) AS d2 FROM based LEFT JOIN dist USING (rid)"


REPORT_SQL = report_sql()
