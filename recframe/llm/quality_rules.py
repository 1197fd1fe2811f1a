"""Quality rules in DataFrame functions only: simple counts and a test of distribution divergence.

Per document two histograms are taken: its characters by class (lower-case and
upper-case letters, digits, white space, common punctuation, others) and its
words by the commonest words of its language (and all others together). Each is
compared by Jensen-Shannon distance (base 2, 0 to 1) with the reference of the
language: the mean of the documents' own histograms, over all documents of
``min_words`` words at least. A document is rejected if a distance is over its limit.
Guards: a histogram of fewer than ``min_words`` words isn't tested, and the limits
grow as 1/sqrt(words), as the distances of short clean texts do. Languages
without a list of common words have a pooled reference of characters and no
test of words.

The references are a handful of rows whatever the input: one for each listed
language and one for the rest. No step shuffles a document; a hot source or
language makes no difference, as documents are assessed one by one.

Defined results: a null text counts as empty, has no words and fails the base
rules; a null language is one without a list; repeated rows are assessed one by
one; other columns pass through ``assess`` untouched, whatever their names, unless
they are named as one of its results, which replaces them, and ``keep`` returns all
of them; texts of any length are judged whole; an empty table gives an empty table.

The input row travels as one struct, so no name of its columns meets one of ours, and
the results leave as one generated row: a filter on them stays above the generator
instead of being pushed down with all that they are made of written out again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: The commonest words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
REST = ""
SPACE = r"[\x20\x09-\x0D]+"
#: Character classes, taken out one after another; what is left is the last class.
CLASSES = [r"\p{Ll}+", r"\p{Lu}+", r"[0-9]+", SPACE, r"[.,;:!?'\"()-]+"]
SPACED = r"[^\x20\x09-\x0D]"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _rows(docs: DataFrame) -> DataFrame:
    """(row, text, lang, words): the input row, its text and listed language ('' for any other), and the text's words."""
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(REST) if "lang" in docs.columns else F.lit(REST)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    return rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))


def _with_histograms(rows: DataFrame) -> DataFrame:
    """Adds classes (array of counts by class) and common (counts of the language's common words, then of all others)."""
    left, sizes = "text", [F.length("text")]
    for k, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"left{k}", F.regexp_replace(left, pattern, ""))
        left = f"left{k}"
        sizes.append(F.length(left))
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    rows = rows.withColumn("classes", F.array(*[a - b for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1]))
    rows = rows.drop(*[f"left{k}" for k in range(len(CLASSES))])
    rows = rows.withColumn("hits", F.concat(F.lit("<"), F.array_join(F.filter("words", lambda w: w.isin(*every)), "><"), F.lit(">")))
    lists = F.create_map(*[x for lang, words in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    rows = rows.withColumn("list", F.coalesce(lists[F.col("lang")], F.array().cast("array<string>")))
    rows = rows.withColumn("counts", F.transform("list", lambda w: ((F.length("hits") - F.length(F.replace(F.col("hits"), F.concat(F.lit("<"), w, F.lit(">")), F.lit("")))) / (F.length(w) + 2)).cast("int")))
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    return rows.withColumn("common", F.concat("counts", F.array(F.size("words") - total))).drop("hits", "list", "counts")


def _with_counts(rows: DataFrame) -> DataFrame:
    """Adds the base counts and base_failed.

    Windows of three words are told apart by a 64-bit hash, of which the low bits make way for the window's place,
    sorted as plain numbers. A window is repeated if one beside it has its hash and its words; only if the hash is the
    same and the words aren't, all windows of the text are asked.
    """
    n = F.size("words")
    rows = (
        rows.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACED)))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("bits", F.length(F.bin(n)))
    )

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
        return F.call_function("shiftleft", F.call_function("shiftright", h, F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long"))

    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("windows", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), packed))).otherwise(none))

    def place(k: Column) -> Column:
        return F.get("windows", k).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")

    def alike(j: Column, k: Column) -> Column:
        hashes = [F.call_function("shiftright", F.get("windows", x), F.col("bits")) for x in (j, k)]
        return F.coalesce(hashes[0] == hashes[1], F.lit(False))

    def equal(j: Column, k: Column) -> Column:
        a, b = place(j), place(k)
        return (F.get("words", a) == F.get("words", b)) & (F.get("words", a + 1) == F.get("words", b + 1)) & (F.get("words", a + 2) == F.get("words", b + 2))

    m = F.size("windows")

    # few windows have a neighbour of the same hash: only those, and these neighbours, are compared by their words
    none = F.array().cast("array<int>")
    rows = rows.withColumn("touch", F.when(m >= 2, F.filter(F.sequence(F.lit(1), m - 1), lambda k: alike(k - 1, k))).otherwise(none))

    def again(k: Column) -> Column:
        anywhere = F.exists(F.sequence(F.lit(0), m - 1), lambda j: (j != k) & alike(j, k) & equal(j, k))
        return F.when(alike(k - 1, k) & equal(k - 1, k), True).when(alike(k + 1, k) & equal(k + 1, k), True).otherwise(anywhere)

    asked = F.array_distinct(F.concat("touch", F.transform("touch", lambda k: k - 1)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(F.filter(asked, again), place)))
    s = F.size("starts")
    steps = F.aggregate(F.sequence(F.lit(1), s - 1), F.lit(3), lambda a, k: a + F.least(F.lit(3), F.get("starts", k) - F.get("starts", k - 1)))
    rows = rows.withColumn("n_repeat_words", F.when(s == 0, 0).when(s == 1, 3).otherwise(steps).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.drop("lines", "bits", "windows", "touch", "starts")


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def references(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(lang, class_reference, word_reference): at most one row for each listed language and one for the rest.

    The mean of the shares of all documents of ``min_words`` words at least; a language that no document is in has no
    row. One pass adds up the shares by language; the rest's reference is made of all languages' sums.
    """
    rows = _rows(docs)
    rows = _with_histograms(rows.select("lang", F.explode(F.array(F.struct("text", "words"))).alias("x")).select("lang", "x.*").filter(F.size("words") >= min_words))
    classes, words = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    shares = rows.select("lang", _shares("classes").alias("c"), _shares("common").alias("w"))
    sums = [F.sum(F.get(name, F.lit(k))).alias(f"{name}{k}") for name, size in (("c", classes), ("w", words)) for k in range(size)]
    found = {r["lang"]: r for r in shares.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    out = [(lang, [r[f"c{k}"] / r["n"] for k in range(classes)], [r[f"w{k}"] / r["n"] for k in range(words)]) for lang, r in found.items() if lang != REST]
    if total := sum(r["n"] for r in found.values()):
        out.append((REST, [sum(r[f"c{k}"] for r in found.values()) / total for k in range(classes)], []))
    return rows_of(docs.sparkSession, out, pa.schema({"lang": pa.string(), "class_reference": pa.list_(pa.float64()), "word_reference": pa.list_(pa.float64())}))


def distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length: the root of the divergence in bits."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    total = F.aggregate(F.zip_with(shares, reference, lambda p, q: part(p, q) + part(q, p)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _judged(docs: DataFrame, min_words: int, class_limit: float, word_limit: float, slack: float, found: DataFrame | None) -> DataFrame:
    """(row, METRICS): the input row as a struct and the results."""
    found = references(docs, min_words) if found is None else found
    full = _with_histograms(_with_counts(_rows(docs))).join(F.broadcast(found), "lang", "left")  # five rows
    tested = (F.col("n_words") >= min_words) & F.col("class_reference").isNotNull()
    full = full.withColumn("class_distance", F.when(tested, distance(_shares("classes"), F.col("class_reference"))))
    full = full.withColumn("word_distance", F.when(tested & (F.size("word_reference") > 0), distance(_shares("common"), F.col("word_reference"))))
    extra = slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > class_limit + extra / 4) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit + extra)
    return full.withColumn("kept", ~F.col("base_failed") & ~diverges).select("row", F.inline(F.array(F.struct(*METRICS))))


def assess(docs: DataFrame, min_words: int = 50, class_limit: float = 0.15, word_limit: float = 0.15, slack: float = 1.0, found: DataFrame | None = None) -> DataFrame:
    """``docs`` (text, and lang if there is one) with the columns METRICS.

    ``slack``: over the square root of the number of words, what is added to a limit (a quarter of it for characters).
    ``found``: references of another corpus, instead of those of ``docs``.
    """
    out = _judged(docs, min_words, class_limit, word_limit, slack, found)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in METRICS], *METRICS)


def keep(docs: DataFrame, min_words: int = 50, class_limit: float = 0.15, word_limit: float = 0.15, slack: float = 1.0, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    out = _judged(docs, min_words, class_limit, word_limit, slack, found)
    return out.filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _sql() -> str:
    """The assessment in DuckDB, distances to six places; the limits are the defaults of ``assess``."""
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON_WORDS.items())
    left, steps = "t", []
    for k, pattern in enumerate(CLASSES):
        quoted = pattern.replace("'", "''")
        steps.append(f"regexp_replace({left}, '{quoted}', '', 'g') AS l{k}")
        left = f"l{k}"
    chain = "d0"
    ctes = []
    for k, step in enumerate(steps):
        ctes.append(f"d{k + 1} AS (SELECT *, {step} FROM {chain})")
        chain = f"d{k + 1}"
    names = ["t", *[f"l{k}" for k in range(len(CLASSES))]]
    classes = ", ".join([*[f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)], f"length({names[-1]})"])
    n_classes, n_words = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    mean = lambda v, n: "[" + ", ".join(f"avg({v}[{k}])" for k in range(1, n + 1)) + "]"
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END)"
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: {part('x[1]', 'x[2]')} + {part('x[2]', 'x[1]')})) / 2, 0))"
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d0 AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(repr(x) for x in COMMON_WORDS)}) THEN lang ELSE '' END AS g,
  regexp_extract_all(coalesce(text, ''), '{word}+') AS ws FROM documents), {', '.join(ctes)},
m AS (SELECT rn, doc_id, g, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, [{classes}] AS cls, CASE g {lists} ELSE [] END AS common FROM {chain}),
u AS (SELECT rn, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM m WHERE len(ws) > 2), v AS (SELECT rn, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM u),
s AS (SELECT rn, unnest(list(i)) AS i FROM v GROUP BY rn, k HAVING count(*) > 1), r AS (SELECT rn, count(DISTINCT i + o) AS n FROM s, (VALUES (0), (1), (2)) x(o) GROUP BY rn),
h AS (SELECT m.*, coalesce(r.n, 0) AS rep, list_transform(common, lambda c: len(list_filter(ws, lambda x: x = c))) AS hits FROM m LEFT JOIN r USING (rn)),
f AS (SELECT rn, doc_id, g, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, rep AS n_repeat_words,
  n_words < 50 OR 100 * rep > 50 * n_words AS base_failed, list_transform(cls, lambda x: x / greatest(list_sum(cls), 1)) AS p,
  list_transform(list_append(hits, n_words - CAST(coalesce(list_sum(hits), 0) AS BIGINT)), lambda x: x / greatest(n_words, 1)) AS q FROM h),
a AS (SELECT g, {mean('p', n_classes)} AS rp, {mean('q', n_words)} AS rq FROM f WHERE n_words >= 50 AND g <> '' GROUP BY g UNION ALL SELECT '', {mean('p', n_classes)}, [] FROM f WHERE n_words >= 50),
z AS (SELECT f.*, CASE WHEN n_words >= 50 AND rp IS NOT NULL THEN {js('p', 'rp')} END AS cd, CASE WHEN n_words >= 50 AND len(rq) > 0 THEN {js('q', 'rq')} END AS wd FROM f LEFT JOIN a USING (g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND NOT (coalesce(cd, 0) > 0.15 + 0.25 / sqrt(greatest(n_words, 1)) OR coalesce(wd, 0) > 0.15 + 1 / sqrt(greatest(n_words, 1))) AS kept FROM z
"""


SQL = _sql()
