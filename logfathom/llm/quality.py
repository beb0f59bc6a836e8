"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: its characters over eight classes, and its
words over the most frequent words of its language plus one bin for all
others. Both are compared with the reference of the language by the
Jensen-Shannon distance (base 2, 0 to 1). References are counted from all
documents; documents whose language is null or too rare use the one of all
documents together. A text shorter than the guard of a histogram is not judged
by it: short samples diverge by chance.

``word_limit`` is absolute. The farthest a text without any common word can be
depends on the reference (about 0.45 where the common words cover a third of
the language), so that limit alone may be out of reach. ``word_part`` adds a
limit relative to that distance.

Defined cases: null text has no words and fails the base rules, like empty
text. Rows are judged one by one, so repeated rows get equal verdicts. Without
any reference (an empty table, or no text long enough) only the base rules
decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, spare_name, stored, within_bound

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
# One letter stands for each common word while they are counted.
MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Places of the table that finds a common word by its hash, and seeds tried to
# give each word a place of its own; one seed fails in half of all cases.
SLOTS, SEEDS = 2048, 64
# Parts of a language's words that are ranked apart.
PARTS = 64
# Patterns of the character classes, which share no character; the last class
# is everything else.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[ ]", r"[\x09-\x0D]", r"[.,;:!?'\x22()-]", r"[#*$%&|<>=_/\\@+~^{}\[\]]")
# Their order when they are counted: the most frequent first, symbols last.
BY_FREQUENCY = (0, 3, 1, 5, 4, 2, 6)


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    common: int = 50  # common words per language, as many as MARKS at most
    least_reference_words: int = 5000  # a language with fewer uses the common reference
    class_guard: int = 400  # characters
    word_guard: int = 60  # words
    class_limit: float = 0.22
    word_limit: float = 0.45
    # Of the distance of a text without a common word. On sf0.1, texts of at least
    # 60 words beyond it: 8% under their own language (half of them fail the base
    # rules, most others are joined by '|'), 99% or more under another one, but 9
    # to 11% of French as Spanish and back.
    word_part: float | None = 0.85


def class_counts(df: DataFrame) -> DataFrame:
    """Add ``__size``, ``__classes`` (the characters of each class) and ``n_symbols``.

    A class is counted by taking it out of what the classes before left, so
    most characters are looked at by the first patterns only.
    """
    df = df.withColumn("__left_0", F.regexp_replace("__text", f"{CLASSES[BY_FREQUENCY[0]]}+", ""))
    for i, k in enumerate(BY_FREQUENCY[1:], 1):
        df = df.withColumn(f"__left_{i}", F.regexp_replace(f"__left_{i - 1}", f"{CLASSES[k]}+", ""))
    size = F.length("__text")
    left = [size, *[F.length(f"__left_{i}") for i in range(len(CLASSES))]]
    counts = {k: (left[i] - left[i + 1]).cast("bigint") for i, k in enumerate(BY_FREQUENCY)}
    # the symbols are of the class that is taken out last
    last = f"__left_{len(CLASSES) - 2}"
    symbols = F.length(last) - F.length(F.regexp_replace(last, SYMBOLS, ""))
    df = df.withColumns(
        {"__size": size, "__classes": F.array(*[counts[k] for k in range(len(CLASSES))]), "n_symbols": symbols.cast("bigint")}
    )
    return df.drop(*[f"__left_{i}" for i in range(len(CLASSES))])


def text_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts and those of the character classes. Each step is
    computed once: later steps refer to its column more than once."""
    df = class_counts(df.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    df = df.withColumns(
        {
            "__words": F.array_remove(F.split("__text", BLANK + "+"), ""),
            "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    window = F.transform(
        "__words", lambda x, i: F.xxhash64(x, *[F.get("__words", i + k) for k in range(1, 5)])
    )
    n = F.size("__words")
    df = df.withColumn("__hashes", F.when(n >= 5, F.slice(window, 1, n - 4)).otherwise(F.array().cast("array<bigint>")))
    # equal windows have equal hashes; where hashes repeat, the words decide
    keyed = F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.struct(F.concat_ws(" ", *[F.get("__words", i + k) for k in range(5)]).alias("k"), i.alias("i")),
    )
    some = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    df = df.withColumn("__sorted", F.when(some, F.sort_array(keyed)))
    twice = F.filter(
        "__sorted",
        lambda x, i: (x["k"] == F.get("__sorted", i - 1)["k"]) | (x["k"] == F.get("__sorted", i + 1)["k"]),
    )
    df = df.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__places", lambda p, j: F.coalesce(F.least(F.lit(5), F.get("__places", j + 1) - p), F.lit(5))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return df.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        }
    )


def letter_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def word_references(docs: DataFrame, rules: Rules, lang_col: str, text_col: str) -> DataFrame:
    """(lang, words, shares, rest, none): the common words of each language and of
    all; ``rest`` is the shares with that of all other words, ``none`` the distance
    of a text without a common word.

    Words are counted per language in each task first; the sum over all
    languages is made of these counts, so its key is not hot.
    """
    words = docs.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.explode(letter_words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("word"),
    )
    counts = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    every = counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    both = counts.filter("lang IS NOT NULL").select("lang", "word", "n").unionByName(every)
    total = both.groupBy("lang").agg(F.sum("n").alias("total")).filter(
        F.col("lang").isNull() | (F.col("total") >= rules.least_reference_words)
    )
    # the top words of each part of a language, of which there are few, then theirs
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part")
    order = [F.desc("n"), F.asc("word")]
    top = both.select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    top = top.filter(F.col("place") <= rules.common)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= rules.common)
    top = top.join(total, top["lang"].eqNullSafe(total["lang"])).drop(total["lang"])
    row = F.sort_array(F.collect_list(F.struct("place", "word", (F.col("n") / F.col("total")).alias("share"))))
    refs = (
        top.groupBy("lang").agg(row.alias("rows"))
        .select("lang", F.col("rows.word").alias("words"), F.col("rows.share").alias("shares"))
    )
    rest = F.lit(1.0) - F.aggregate("shares", F.lit(0.0), lambda a, b: a + b)
    refs = refs.withColumn("rest", F.concat("shares", F.array(rest)))
    none = F.concat(F.transform("shares", lambda x: F.lit(0.0)), F.array(F.lit(1.0)))
    return with_slots(refs.withColumn("none", js_distance(none, F.col("rest"))))


def slot(word: Column, seed: Column) -> Column:
    return F.pmod(F.xxhash64(word, seed), F.lit(SLOTS)).cast("int")


def with_slots(refs: DataFrame) -> DataFrame:
    """Add ``seed`` and ``slots``: the number of the word in each place, or 0.

    The seed is the first one that gives every word a place of its own.
    """
    seeds = F.filter(
        F.sequence(F.lit(1), F.lit(SEEDS)),
        lambda k: F.size(F.array_distinct(F.transform("words", lambda w: slot(w, k)))) == F.size("words"),
    )
    refs = refs.withColumn("seed", F.get(seeds, F.lit(0)))
    refs = refs.withColumn("__taken", F.transform("words", lambda w: slot(w, F.col("seed"))))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.array_position("__taken", i).cast("tinyint"))
    return refs.withColumn("slots", slots).drop("__taken")


def with_reference(df: DataFrame, refs: DataFrame, lang: str, few: bool) -> DataFrame:
    """Join each row to the reference of its language, else to the one of all.

    One reference has a few dozen words. They are broadcast if there are few
    (a measured number); otherwise they are shuffled, and a hot language is
    split by the skew join of adaptive execution.
    """
    own = refs.filter("lang IS NOT NULL").withColumnRenamed("lang", "__lang")
    out = df.join(F.broadcast(own) if few else own, F.col(lang) == F.col("__lang"), "left").drop("__lang")
    spare = refs.filter("lang IS NULL").select([F.col(c).alias(f"__all_{c}") for c in refs.columns if c != "lang"])
    out = out.join(F.broadcast(spare), F.lit(True), "left")  # one row at most
    values = [c for c in refs.columns if c != "lang"]
    return out.withColumns({c: F.coalesce(c, f"__all_{c}") for c in values}).drop(*[f"__all_{c}" for c in values])


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of shares of one length."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / total)


def judged(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The base counts, both distances and the verdict of every row.

    ``keep`` names columns of ``docs`` to carry along.
    """
    refs = stored(word_references(docs, rules, lang_col, text_col), "word-references")
    few = refs.count() <= 1000
    df = docs.select(
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
        F.col(lang_col).cast("string").alias("__language"), F.col(text_col).alias("text"),
    )
    df = with_reference(text_columns(df), refs, "__language", few)
    df = df.withColumn("__tokens", letter_words(F.col("__text")))
    number = lambda t: F.get("slots", slot(t, F.col("seed"))).cast("int")
    df = df.withColumn("__near", F.filter("__tokens", lambda t: number(t) > 0))
    hits = F.transform(
        F.filter("__near", lambda t: F.get("words", number(t) - 1) == t), lambda t: F.substring(F.lit(MARKS), number(t), F.lit(1))
    )
    df = df.withColumn("__hits", F.coalesce(F.array_join(hits, ""), F.lit("")))
    df = df.withColumns(
        {
            "__counts": F.transform(
                F.sequence(F.lit(1), F.size("words")),
                lambda k: F.length("__hits") - F.length(F.replace(F.col("__hits"), F.substring(F.lit(MARKS), k, F.lit(1)), F.lit(""))),
            ),
            "__n_tokens": F.size("__tokens"),
        }
    )
    common = F.aggregate("__counts", F.lit(0), lambda a, b: a + b)
    p = shares(F.concat("__counts", F.array(F.col("__n_tokens") - common)), F.col("__n_tokens"))
    df = df.withColumn("word_js", F.when(F.col("__n_tokens") >= rules.word_guard, js_distance(p, F.col("rest"))))
    far = F.lit(False)
    if rules.word_part is not None:
        far = F.coalesce(F.col("word_js") > rules.word_part * F.col("none"), F.lit(False))
    df = df.withColumn("__far", far)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # texts end here: the rest is a small row per document
    rows = stored(
        df.select(*[f"__keep_{i}" for i in range(len(keep))], "__language", "__size", "__classes", "word_js", "__far", *base), "features"
    )
    own = with_rest([F.get("__classes", F.lit(i)) for i in range(len(CLASSES))], F.col("__size"))
    distance = F.when(F.col("__size") >= rules.class_guard, js_distance(own, F.col("profile")))
    # the second reference leaves out what is far from the first, so that junk
    # does not pull the reference towards itself
    first = with_reference(rows, class_profiles(rows, refs), "__language", few).withColumn("class_js", distance)
    near = first.filter(F.coalesce(F.col("class_js") <= rules.class_limit, F.lit(True)))
    rows = with_reference(rows, stored(class_profiles(near, refs), "profiles"), "__language", few)
    rows = rows.withColumn("class_js", distance)
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    diverges = F.coalesce(F.col("class_js") > rules.class_limit, F.lit(False)) | F.coalesce(
        F.col("word_js") > rules.word_limit, F.lit(False)
    ) | F.col("__far")
    return rows.select(
        *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
        *base, failed.alias("base_failed"), (~failed & ~diverges).alias("kept"), "class_js", "word_js",
    )


def class_profiles(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(lang, profile) of the languages that have a word reference, and of all."""
    n = len(CLASSES)
    sums = rows.groupBy(F.col("__language").alias("lang")).agg(
        *[F.sum(F.get("__classes", F.lit(i))).alias(f"c{i}") for i in range(n)], F.sum("__size").alias("size")
    )
    every = sums.agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).withColumn("lang", F.lit(None).cast("string"))
    known = refs.select(F.col("lang").alias("known"))
    own = sums.join(known, F.col("lang") == F.col("known"), "left_semi")
    both = own.unionByName(every.select(*sums.columns)).filter("size > 0")
    return both.select("lang", with_rest([F.col(f"c{i}") for i in range(n)], F.col("size")).alias("profile"))


def with_rest(counts: list[Column], total: Column) -> Column:
    """The shares of the classes, and of what is in none of them."""
    rest = total
    for c in counts:
        rest = rest - c
    return F.array(*[(c / total) for c in counts], rest / total)


def keep_good(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows whose verdict is to keep them, with all their columns. A verdict
    follows from text and language, so these name it, whatever the ids are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.sha2(text.cast("binary"), 256), F.col(lang_col).cast("string"))
    name = spare_name(docs, "__key")
    rows = docs.withColumn(name, key)
    bad = judged(rows, rules, lang_col, text_col, keep=(name,)).filter(~F.col("kept")).select(name).distinct()
    return rows.join(within_bound(bad), name, "left_anti").select(*docs.columns)


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), keep=("doc_id",)).drop("class_js", "word_js")


def js_sql(p: str, q: str) -> str:
    one = "CASE WHEN {0} > 0 THEN {0} * log2(2.0 * {0} / ({0} + {1})) ELSE 0.0 END"
    both = f"({one.format('x[1]', 'x[2]')} + {one.format('x[2]', 'x[1]')}) / 2"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda x: {both}))))"


def profile_sql(table: str) -> str:
    """Class profiles of the languages with a word reference, and of all (null)."""
    n = len(CLASSES)
    sums = ", ".join(f"sum(c[{i + 1}])" for i in range(n))
    rest = " - ".join(["sum(size)", *[f"sum(c[{i + 1}])" for i in range(n)]])
    lists = f"[{sums}, {rest}]"
    return f"""SELECT lang, list_transform(counts, lambda x: x / total) AS profile FROM (
        SELECT lang, {lists} AS counts, sum(size) AS total FROM (
            SELECT lang, c, size FROM {table} WHERE lang IN (SELECT lang FROM refs) UNION ALL SELECT NULL, c, size FROM {table}
        ) GROUP BY lang) WHERE total > 0"""


def oracle(rules: Rules = Rules()) -> str:
    counts = ", ".join("length(t) - length(regexp_replace(t, '{}+', '', 'g'))".format(c.replace("'", "''")) for c in CLASSES)
    own = "list_transform(list_append(c, size - list_sum(c)), lambda x: x / size)"
    rest = "list_append(shares, 1.0 - list_sum(shares))"
    far = f"{rules.word_part} * {js_sql('list_append(list_transform(shares, lambda x: 0.0), 1.0)', rest)}" if rules.word_part is not None else "NULL"
    judged_by = f"""SELECT f.*, CASE WHEN size >= {rules.class_guard} THEN {js_sql(own, 'p.profile')} END AS js FROM features f
        JOIN {{0}} p ON p.lang IS NOT DISTINCT FROM (CASE WHEN f.lang IN (SELECT lang FROM refs) THEN f.lang END)"""
    return f"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
                     regexp_extract_all(lower(t), '\\p{{L}}+') AS k FROM d),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
        steps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS s FROM windows WHERE n > 1),
        covered AS (SELECT doc_id, sum(s) AS n FROM steps GROUP BY doc_id),
        words AS (SELECT doc_id, lang, unnest(k) AS word FROM w),
        counts AS (SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY ALL
                   UNION ALL SELECT NULL, word, count(*) FROM words GROUP BY word),
        totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang HAVING lang IS NULL OR sum(n) >= {rules.least_reference_words}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counts),
        refs AS (SELECT t.lang, list(word ORDER BY place) AS words, list(n / total ORDER BY place) AS shares
                 FROM ranked r JOIN totals t ON r.lang IS NOT DISTINCT FROM t.lang WHERE place <= {rules.common} GROUP BY t.lang),
        own AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
        hists AS (SELECT w.doc_id, len(any_value(k)) AS m, list(coalesce(o.n, 0) ORDER BY r.i) AS h, any_value(r.shares) AS shares
                  FROM w JOIN (SELECT lang, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, shares FROM refs) r
                       ON r.lang IS NOT DISTINCT FROM (CASE WHEN w.lang IN (SELECT lang FROM refs) THEN w.lang END)
                  LEFT JOIN own o ON o.doc_id = w.doc_id AND o.word = r.word GROUP BY w.doc_id),
        divergence AS (SELECT doc_id, CASE WHEN m >= {rules.word_guard} THEN {js_sql('list_transform(list_append(h, m - list_sum(h)), lambda x: x / m)', rest)} END AS js,
                              {far} AS far FROM hists),
        features AS (SELECT doc_id, lang, length(t) AS size, [{counts}] AS c FROM d),
        profile1 AS ({profile_sql('features')}),
        judged1 AS ({judged_by.format('profile1')}),
        near AS (SELECT lang, c, size FROM judged1 WHERE js IS NULL OR js <= {rules.class_limit}),
        profile2 AS ({profile_sql('near')}),
        judged2 AS ({judged_by.format('profile2')}),
        base AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                        CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
                        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
                 FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id)
        SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
               NOT failed AND NOT coalesce(j.js > {rules.class_limit}, false) AND NOT coalesce(v.js > {rules.word_limit} OR v.js > v.far, false) AS kept
        FROM (SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS failed FROM base) b
        LEFT JOIN judged2 j ON j.doc_id = b.doc_id LEFT JOIN divergence v ON v.doc_id = b.doc_id
    """


QUERIES = {"op3_quality_divergence": op3_quality_divergence}
ORACLES = {"op3_quality_divergence": oracle()}
