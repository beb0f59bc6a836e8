"""Personal data by bootstrapped contextual extraction, in DataFrame functions.

Seeds are the matches of fixed forms (``FORMS``). Looser forms (``LOOSE``) give
candidates, which count for a kind if their digits fit. What stands around a
match are its lexical patterns: the word before, the two words before, and the
word after. A number counts as '#', the start of a line or of the text as '^',
its end as '$', and another match of the same form as '&', so a cue of one word,
a list, or a text that begins with a number have patterns too. Patterns reach as
far as their words do.

Patterns and instances form a bipartite graph without repeats. In each round a
pattern's confidence for a kind is the trust in its instances of that kind over
the number of all its instances, if enough of them are trusted; a candidate's
trust is the chance that at least one of its patterns is right. Candidates with
enough trust at the end are found spans; they are added to the seeds, which
always stay.

Positions are code points. All forms begin where a run of their characters
begins or where the last match ended, which is where the leftmost match begins,
so a text is scanned in linear time; repetition is possessive, so long runs
need no stack.

Defined cases: null text is empty and has no spans. Repeated rows are judged
alike and returned each. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, join_hot, stored

KINDS = ("email", "ip", "card", "phone")
# Seeds: leftmost, non-overlapping; a match that fails its rule is dropped.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates: an address without a full host, and groups of digits.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9.-]*+[A-Za-z0-9-]"
    r"|(?<![A-Za-z0-9])[0-9](?:[\x20()./-]{0,2}+[0-9])*+(?![A-Za-z0-9])"
)
MARK, OTHER = "\x01", "\x02"
CHUNK = 128  # pieces of a text whose places are summed in one go
TOKEN = r"[^\p{L}\p{N}\n]*+(\p{L}++|\p{N}++)"


@dataclass(frozen=True)
class Trust:
    rounds: int = 3
    least_support: int = 3  # trusted instances of a pattern
    least_confidence: float = 0.5  # of a pattern that may vouch for candidates
    least_trust: float = 0.6  # of a candidate that becomes a span


def matches(text: Column, form: str) -> Column:
    """Array of (start, end, found) of a form in a text without ``MARK``.

    The text is split at marks put around the matches, so every second piece is
    a match; places are sums of lengths, taken in chunks.
    """
    return F.when(text.rlike(form), F.split(F.regexp_replace(text, f"({form})", f"{MARK}$1{MARK}"), MARK))


def places(df: DataFrame, pieces: str, out: str) -> DataFrame:
    """Turn an array of pieces (match at every second one) into structs."""
    count = F.coalesce(F.size(pieces), F.lit(0))
    chunks = F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / CHUNK).cast("int"))
    sums = F.transform(
        chunks,
        lambda c: F.aggregate(F.slice(pieces, c * CHUNK + 1, CHUNK), F.lit(0), lambda a, x: a + F.length(x)),
    )
    df = df.withColumn("__sums", F.when(F.col(pieces).isNotNull(), sums))
    bases = F.aggregate(
        "__sums", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    df = df.withColumn("__bases", bases)
    empty = F.array().cast("array<struct<start:int,end:int,found:string,patterns:array<string>>>")

    def chunk(base: Column, c: Column) -> Column:
        start = F.struct(base.alias("at"), F.lit(0).alias("i"), empty.alias("out"))

        def step(a: Column, x: Column) -> Column:
            i = c * CHUNK + a["i"]
            around = patterns(F.get(pieces, i - 1), F.get(pieces, i + 1), i == 1, i == count - 2)
            here = F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("found"), around.alias("patterns"))
            return F.struct(
                (a["at"] + F.length(x)).alias("at"), (a["i"] + 1).alias("i"),
                F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"),
            )

        return F.aggregate(F.slice(pieces, c * CHUNK + 1, CHUNK), start, step, lambda a: a["out"])

    found = F.flatten(F.transform("__bases", chunk))
    return df.withColumn(out, F.coalesce(found, empty)).drop("__sums", "__bases", pieces)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    size = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((size - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), size), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def between(x: Column, low: int, high: int) -> Column:
    return (x >= low) & (x <= high)


def seed_rule(kind: str, found: Column) -> Column:
    n = F.length(digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(between(n, 12, 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return between(n, 9, 15)
    return F.lit(True)


def fitting_kinds(found: Column) -> Column:
    """The kinds a candidate may be of."""
    n = F.length(digits(found))
    mail = found.rlike(r"@|\[at\]|\(at\)")
    parts = F.length(found) - F.length(F.replace(found, F.lit("."), F.lit("")))
    fits = {"email": mail, "ip": ~mail & (parts == 3) & between(n, 4, 12), "card": ~mail & between(n, 12, 19), "phone": ~mail & between(n, 7, 15)}
    return F.array_compact(F.array(*[F.when(fits[k], F.lit(k)) for k in KINDS]))


def token(found: Column, backwards: bool) -> Column:
    """A word in lower case, or '#' for a number; empty if there is none."""
    word = F.lower(F.reverse(found)) if backwards else F.lower(found)
    return F.when(found.rlike(r"^\p{N}"), F.lit("#")).otherwise(word)


def patterns(before: Column, after: Column, first: Column, last: Column) -> Column:
    """The patterns of a match between two pieces of text; ``first`` and ``last``
    say that these begin and end the whole text."""
    back = F.reverse(before)
    one = token(F.regexp_extract(back, f"^{TOKEN}", 1), True)
    two = token(F.regexp_extract(back, f"^{TOKEN}{TOKEN}", 2), True)
    nearest = F.when(one != "", one).when(first | back.rlike(r"^[^\p{L}\p{N}]*+\n"), "^").otherwise("&")
    farther = F.when(two != "", two).when(first | back.rlike(rf"^{TOKEN}[^\p{{L}}\p{{N}}]*+\n"), "^").otherwise("&")
    next_ = token(F.regexp_extract(after, f"^{TOKEN}", 1), False)
    next_ = F.when(next_ != "", next_).when(last | after.rlike(r"^[^\p{L}\p{N}]*+\n"), "$").otherwise("&")
    return F.array_compact(
        F.array(
            F.concat(F.lit("< "), nearest), F.when(one != "", F.concat_ws(" ", F.lit("<"), farther, nearest)), F.concat(F.lit("> "), next_)
        )
    )


def valid(kind: str) -> Column:
    return F.filter(kind, lambda m: seed_rule(kind, m["found"]))


def named(kind: str) -> Column:
    return F.transform(
        kind,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), m["found"].alias("found"), m["patterns"].alias("patterns"),
        ),
    )


def number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document without its text: row, id, base (seeds), loose."""
    df = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(MARK), F.lit(OTHER)).alias("text"),
    )
    for kind, form in FORMS.items():
        df = df.withColumn(f"__{kind}", matches(F.col("text"), form))
    df = df.withColumn("__loose", matches(F.col("text"), LOOSE))
    for kind in FORMS:
        df = places(df, f"__{kind}", kind)
        df = df.withColumn(kind, valid(kind))
    df = places(df, "__loose", "loose")
    df = df.withColumn("base", F.sort_array(F.concat(*[named(kind) for kind in KINDS])))
    loose = F.filter(
        F.filter("loose", lambda m: F.size(fitting_kinds(m["found"])) > 0),
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    loose = F.transform(
        loose,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"),
            fitting_kinds(m["found"]).alias("kinds"), m["patterns"].alias("patterns"),
        ),
    )
    return df.select("row", "id", "base", loose.alias("loose"))


def trusted(rows: DataFrame, trust: Trust) -> DataFrame:
    """(found, kind) of the candidates that the patterns vouch for.

    A pattern without seeds starts without support; candidates that were found
    through other patterns give it support in the next round.
    """
    seeds = rows.select(F.explode("base").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.kind", "s.found")
    loose = rows.select(F.explode("loose").alias("c")).select(F.explode("c.patterns").alias("pattern"), "c.kinds", "c.found")
    seeds = seeds.distinct()
    edges = stored(loose.distinct().select("pattern", F.explode("kinds").alias("kind"), "found"), "loose-edges")
    n_edges = edges.count()
    # a pattern that no candidate has can vouch for none
    names = edges.groupBy("pattern").agg(F.count_distinct("found").alias("b"))
    seeded = seeds.join(names, "pattern", "left_semi").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeded = stored(seeded, "seed-patterns")
    total = names.join(seeded.groupBy("pattern").agg(F.sum("seeds").alias("a")), "pattern", "left").select(
        "pattern", (F.coalesce("a", F.lit(0)) + F.col("b")).alias("all")
    )
    known = edges.select("pattern", "kind").distinct().join(seeded, ["pattern", "kind"], "left").join(total, "pattern")
    known = stored(known.select("pattern", "kind", F.coalesce("seeds", F.lit(0)).alias("seeds"), "all"), "patterns")
    by_found = edges.groupBy("found", "kind").agg(F.count("*").alias("edges"))
    scores = known.withColumn("sum", F.col("seeds").cast("double")).withColumn("support", F.col("seeds"))
    found = None
    for _ in range(trust.rounds):
        sure = scores.filter(F.col("support") >= trust.least_support).select(
            "pattern", "kind", "all", F.least(F.lit(1.0), F.col("sum") / F.col("all")).alias("confidence")
        )
        sure = stored(sure.filter(F.col("confidence") >= trust.least_confidence), "sure")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        vouched = join_hot(edges, sure, ["pattern", "kind"], "all", n_edges, "inner")
        found = vouched.groupBy("found", "kind").agg((1 - F.exp(doubt)).alias("trust"))
        found = stored(found.join(by_found, ["found", "kind"]), "trust")
        gained = join_hot(edges, found, ["found", "kind"], "edges", n_edges, "inner").groupBy("pattern", "kind").agg(
            F.sum("trust").alias("more"), F.count(F.when(F.col("trust") >= 0.5, 1)).alias("n")
        )
        scores = known.join(gained, ["pattern", "kind"], "left").select(
            "pattern", "kind", "all", (F.col("seeds") + F.coalesce("more", F.lit(0.0))).alias("sum"),
            (F.col("seeds") + F.coalesce("n", F.lit(0))).alias("support"),
        )
    return found.filter(F.col("trust") >= trust.least_trust).select("found", "kind", "trust")


def found_spans(docs: DataFrame, trust: Trust = Trust(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, base and all spans, as (start, place, end, kind)."""
    rows = stored(extracted(docs, id_col, text_col), "personal")
    sure = stored(trusted(rows, trust), "trusted")
    spots = rows.filter(F.size("loose") > 0).select("row", F.explode("loose").alias("c")).select("row", "c.start", "c.end", "c.found")
    often = spots.groupBy("found").agg(F.count("*").alias("spots"))
    best = sure.groupBy("found").agg(F.max(F.struct("trust", "kind"))["kind"].alias("kind"))
    best = stored(best.join(often, "found"), "found")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    more = (
        join_hot(spots, best, ["found"], "spots", rows.agg(F.sum(F.size("loose"))).first()[0] or 0, "inner")
        .groupBy("row").agg(F.collect_list(F.struct("start", place.alias("place"), "end", "kind")).alias("more"))
    )
    short = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["place"].alias("place"), b["end"].alias("end"), b["kind"].alias("kind")))
    return rows.join(more, "row", "left").select(
        F.col("id").alias(id_col), short.alias("base"), F.sort_array(F.concat(short, F.coalesce("more", F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")))).alias("spans")
    )


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found_spans(documents(spark, sf_dir))
    counts = [number_of("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op8_personal_data": op8_personal_data}
ORACLES: dict[str, str] = {}
