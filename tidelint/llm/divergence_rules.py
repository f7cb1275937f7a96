"""Quality rules by the divergence of a document's histograms from its language's.

Two histograms are taken of every whole text: character classes, and the ten
common words of its language against all other words. The reference of a
language is the sum over all its documents. The Jensen-Shannon distance (base 2,
0 to 1) to it must stay below a limit, once a text has enough words for its
histogram to say something. Before that come base rules on length and repetition.

All of it is expressions over one row but for the references, a partial
aggregate with one row a language; texts are read once and the counts stored.

Null counts as an empty text, which fails the base rules. A language without
common words of its own is compared by character classes only; a null language
counts as one language. Repeated words are found through hashes of 64 bits less
those that number the places in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames

# Common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich",
    "en": "the of and to in a is that for it",
    "es": "de la que el en y los se del las",
    "fr": "de la le et les des en un du une",
}
#: (words a text needs, largest distance) for each histogram.
CHARACTERS, WORDS = (50, 0.27), (100, 0.24)
_CLASSES = ("upper", "digit", "point", "symbol", "space", "other")
_BLANK = "\\x20\\x09-\\x0D"
_K = 10


def counted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, n_words, the base counts, and both histograms as arrays of counts."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    common = F.create_map(*[F.lit(x) for k, v in COMMON.items() for x in (k, F.array(*map(F.lit, v.split())))])
    only = lambda kind: F.length(F.regexp_replace("t", f"[^{kind}]+", ""))
    rows = docs.select("doc_id", lang.alias("lang"), text.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", f"[{_BLANK}]+"), ""))
    rows = rows.select("doc_id", "lang", "t", "w", F.size("w").cast("bigint").alias("n_words"),
                       F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
                       F.size(F.regexp_extract_all("t", F.lit("[#*$%&|<>]"), 0)).cast("bigint").alias("n_symbols"),
                       _repeated_lines("t").alias("n_dup_lines"),
                       F.greatest(F.lit(1), F.ceil(F.log2(F.size("w") + F.lit(1)))).cast("int").alias("bits"))
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: (
        F.call_function("shiftleft", F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), F.col("bits"))
        .bitwiseOR(i.cast("bigint"))))
    rows = rows.withColumn("g", F.sort_array(windows))
    top = lambda x: F.call_function("shiftright", x, F.col("bits"))
    same = lambda x, y: F.coalesce(top(x) == top(y), F.lit(False))
    rows = rows.withColumn("g", F.filter("g", lambda x, i: same(x, F.get("g", i + 1)) | (F.when(i > 0, same(x, F.get("g", i - 1))).otherwise(False))))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1
    rows = rows.withColumn("g", F.sort_array(F.transform("g", lambda x: x.bitwiseAND(mask))))
    covered = F.aggregate(F.transform("g", lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get("g", i + 1) - x, F.lit(3).cast("bigint")))),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = rows.select("doc_id", "lang", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
                       F.transform("w", F.lower).alias("w"), F.length("t").cast("bigint").alias("n_chars"),
                       common[F.col("lang")].alias("common"),
                       only("\\p{Lu}").cast("bigint").alias("upper"), only("0-9").cast("bigint").alias("digit"),
                       only(".,;:!?").cast("bigint").alias("point"))
    hits = [(F.size("w") - F.size(F.array_remove("w", F.get("common", F.lit(k))))).cast("bigint").alias(f"h{k}") for k in range(_K)]
    rows = rows.select("*", *hits)
    space = F.col("n_chars") - F.col("word_chars")
    named = F.col("upper") + F.col("digit") + F.col("point") + F.col("n_symbols") + space
    found = [F.coalesce(f"h{k}", F.lit(0)) for k in range(_K)]
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       F.array("upper", "digit", "point", "n_symbols", space, F.col("n_chars") - named).alias("characters"),
                       F.array(*found, F.col("n_words") - sum(found[1:], found[0])).alias("words"))


def judged(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, both distances, base_failed and kept."""
    counts = frames.stored(counted(docs))
    total = lambda name, n: F.array(*[F.sum(F.col(name)[k]) for k in range(n)])
    languages = (counts.groupBy("lang").agg(total("characters", len(_CLASSES)).alias("all_characters"), total("words", _K + 1).alias("all_words"))
                 .select(F.struct("lang").alias("key"), "all_characters", "all_words"))
    rows = counts.withColumn("key", F.struct("lang")).join(languages, "key")
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    rows = (rows.withColumn("character_distance", distance("characters", "all_characters"))
            .withColumn("word_distance", distance("words", "all_words")).withColumn("base_failed", base))
    far = (((F.col("n_words") >= CHARACTERS[0]) & (F.col("character_distance") > CHARACTERS[1]))
           | ((F.col("n_words") >= WORDS[0]) & F.coalesce(F.col("lang").isin(*COMMON), F.lit(False)) & (F.col("word_distance") > WORDS[1])))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "character_distance", "word_distance")


def distance(own: str, other: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 when one is all zero."""
    def shares(name: str) -> Column:
        whole = F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.transform(name, lambda x: x / F.nullif(whole, F.lit(0).cast("bigint")))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(shares(own), shares(other), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _repeated_lines(text: str) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS l,
           row_number() OVER () AS k FROM documents),
g AS (SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT k, i FROM g SEMI JOIN (SELECT k, g FROM g GROUP BY k, g HAVING count(*) > 1) USING (k, g)),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
b AS (SELECT d.k, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars,
      length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit,
      length(regexp_replace(t, '[^.,;:!?]+', '', 'g')) AS point, list_transform(w, lambda x: lower(x)) AS w,
      string_split(CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMON.items())} END, ' ') AS common
      FROM d LEFT JOIN c USING (k)),
h AS (SELECT *, [upper, digit, point, n_symbols, n_chars - word_chars, word_chars - upper - digit - point - n_symbols] AS cc,
      list_transform(range(1, {_K + 1}), lambda j: len(list_filter(w, lambda x: x = common[j]))) AS hits FROM b),
p AS (SELECT k, 1 AS kind, unnest(cc) AS n, unnest(range(1, 7)) AS j, lang FROM h UNION ALL
      SELECT k, 2, unnest(hits || [n_words - list_sum(hits)]), unnest(range(1, {_K + 2})), lang FROM h),
q AS (SELECT k, p.kind, p.n / nullif(sum(p.n) OVER (PARTITION BY k, p.kind), 0) AS p, r.n / nullif(sum(r.n) OVER (PARTITION BY k, p.kind), 0) AS q
      FROM p JOIN (SELECT lang, kind, j, sum(n)::DOUBLE AS n FROM p GROUP BY ALL) r ON p.kind = r.kind AND p.j = r.j AND p.lang IS NOT DISTINCT FROM r.lang),
s AS (SELECT k, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
      FROM q GROUP BY k, kind)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {CHARACTERS[0]} AND x.js > {CHARACTERS[1]}) AND NOT (n_words >= {WORDS[0]} AND coalesce(lang IN ({", ".join(f"'{k}'" for k in COMMON)}), false) AND y.js > {WORDS[1]}) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h) h
LEFT JOIN s x ON x.k = h.k AND x.kind = 1 LEFT JOIN s y ON y.k = h.k AND y.kind = 2
"""
