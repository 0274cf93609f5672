"""Personal data: patterns by kind, and contextual extraction bootstrapped from what they find.

The base matches are seeds, and so are long random keys, a kind of their own that the base does not have. The two words
before a seed are a lexical pattern of its kind. Patterns and the identifiers that stand in them form a graph that is scored
in turns: a pattern is as good as the share of its identifiers that are trusted, an unseen identifier as good as its
patterns together. An unseen identifier is one to six words that pass a loose test of the kind; once it is trusted, the
other patterns that it stands in join the graph. Rounds go on until no score changes. Identifiers above a threshold
become spans, where a trusted pattern introduces them. All of it is DataFrame work; no text leaves the rows it is in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, let, running, settle, stored, table

#: The kinds with base patterns, and the kind that only the method finds.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
#: The base patterns. Starts are limited to those that a search from the left can reach, and repetitions are possessive,
#: so that each text takes linear time; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Seeds of secrets: 32 and more characters of a digest or key, which mix letters with digits.
SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9+/_=-])"
#: A white-space delimited token from its first digit or at sign on, with up to five words after it.
_TOKEN = r"[0-9@]\S*+"
_AFTER = r"[0-9@]\S*+(?=((?:\s\S++){0,5}+))"
#: An address with its at sign, and perhaps its dots, in words or set apart.
_SPELT = r"(?i)(?<!\S)[a-z0-9._%+-]++(?:\s?[\[(]\s?(?:at|@)\s?[\])]\s?|\s(?:at|@)\s|@\s|\s@)[a-z0-9-]++(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[a-z0-9-]++)++"
#: What a text must hold before that is tried.
_MAY_BE_SPELT = r"@|\s[aA][tT]\s|[\[(]\s?[aA][tT]"
#: What may open and close a quoted identifier; it is not part of the identifier.
_OPEN, _END = r"^[\"'<\[]*+", r"(?=[.,;:!?)\]\"'>]*+(?:\s|$))"
#: Loose forms of the kinds, longest first; what an unseen identifier must look like at the start of a run.
LOOSE = {
    "email": _OPEN + r"([^\s@]++@[^\s@]*[^\s@.,;:!?)\]\"'>])",
    "ip": "(?i)" + _OPEN + r"((?:[0-9]{1,5}(?:[\[(]?[.,:][\])]?\s?[0-9]{1,5}){3}|[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7}))" + _END,
    "card": _OPEN + r"((?:[A-Z]{2}[0-9]{2}[ -]?)?[0-9](?:[./ -]{0,2}[0-9]){7,23})" + _END,
    "phone": _OPEN + r"([+(]{0,2}[0-9](?:[()./ -]{0,3}[0-9]){6,14})" + _END,
    "secret": _OPEN + r"((?=[^\s0-9]*+[0-9])[^\s\"'<>]{7,}[^\s.,;:!?)\]\"'>])" + _END,
}
#: Distinct trusted identifiers that a pattern needs; scores that patterns and new identifiers need; decimals of a score.
SUPPORT, TRUSTED, DECIMALS = 3, 0.8, 2
_SPAN = "struct<start:int,stop:int,value:string,before:string>"
_NO_SPANS = "array<struct<kind:int,start:int,stop:int,value:string,before:string>>"


def _before(gap: Column, first: Column) -> Column:
    """The two words that end what stands before a match, given the text since the match before it.

    Lower case; a word with a digit or an at sign, and all of an earlier match, is ``#``; the start of a text is ``^``. What
    opens a quotation next to the match is left out. There may be one word only, or none.
    """
    backward = F.reverse(F.concat(F.when(first, F.lit("^ ")).otherwise(F.lit("#")), gap))
    words = F.lower(F.reverse(F.regexp_extract(backward, r"^[\"'<\[]*+\s*+(\S++(?:\s++\S++)?)", 1)))
    return F.regexp_replace(F.regexp_replace(words, r"\s++", " "), r"[^ 0-9@#]*+[0-9@#][^ ]*+", "#")


def _found(text: Column, pattern: str, after: str | None = None) -> Column:
    """Every match of ``pattern`` with its place in code points and the words before it.

    With ``after``, a pattern of the same matches, each match is widened to the left up to white space, and its value goes on
    with the first group of ``after``.
    """
    wide = after is not None

    def parts(gap: Column, match: Column, more: Column, first: Column) -> Column:
        lead = F.reverse(F.regexp_extract(F.reverse(gap), r"^\S++", 0)) if wide else F.lit("")

        def struct(lead: Column) -> Column:
            rest = F.substring(gap, F.lit(1), F.length(gap) - F.length(lead)) if wide else gap
            value = F.concat(lead, match, more) if wide else match
            return F.struct(F.length(rest).alias("skip"), (F.length(lead) + F.length(match)).alias("n"), value.alias("value"), _before(rest, first).alias("before"))

        return let(lead, struct)

    def spans(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        more = F.regexp_extract_all(text, F.lit(after), F.lit(1)) if wide else matches
        zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), more.alias("more"))
        pairs = F.transform(zipped, lambda x, i: parts(x["gap"], x["match"], x["more"], i == 0))

        def span(at: Column, x: Column) -> Column:
            start = at + x["skip"]
            return F.struct(start.alias("start"), (start + x["n"]).alias("stop"), x["value"].alias("value"), x["before"].alias("before"))

        none = F.array().cast(f"array<{_SPAN}>")
        return F.when(F.size(matches) == 0, none).otherwise(running(pairs, F.lit(0), none, lambda at, x: at + x["skip"] + x["n"], span))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def candidates(text: Column) -> Column:
    """array<struct<kind, start, stop, value, before>>: what looks like an identifier, by the loose forms of all kinds."""

    def of_kind(kind: int, span: Column) -> Column:
        def cut(whole: Column) -> Column:
            value = F.ltrim(whole, F.lit("\"'<["))
            start = span["start"] + F.length(whole) - F.length(value)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), span["before"].alias("before"))

        return let(F.regexp_extract(span["value"], LOOSE[ALL_KINDS[kind]], 0), cut)

    def of_run(span: Column) -> Column:
        return F.filter(F.array(*[of_kind(i, span) for i in range(len(ALL_KINDS))]), lambda c: c["value"] != "")

    runs = F.flatten(F.transform(_found(text, _TOKEN, _AFTER), of_run))
    spelt = F.transform(_found(text, _SPELT), lambda s: _as_kind(0, s))
    none = F.array().cast(_NO_SPANS)
    return F.concat(F.when(text.rlike("[0-9@]"), runs).otherwise(none), F.when(text.rlike(_MAY_BE_SPELT), spelt).otherwise(none))


def _as_kind(number: int, span: Column) -> Column:
    return F.struct(F.lit(number).alias("kind"), *[span[c].alias(c) for c in ("start", "stop", "value", "before")])


def secrets(text: Column) -> Column:
    """array<struct<kind, start, stop, value, before>>: the seeds of the kind that has no base pattern."""
    found = F.transform(_found(text, SECRET), lambda s: _as_kind(len(KINDS), s))
    return F.when(text.rlike("[0-9a-f]{32}"), found).otherwise(F.array().cast(_NO_SPANS))


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.when(F.ltrim(part, F.lit("0")) == "", 0).otherwise(256)) <= 255)
    if kind == "card":
        ordered = F.split(F.reverse(digits), "(?<=.)(?=.)")
        doubled = F.transform(ordered, lambda d, i: F.when(i % 2 == 1, F.lit(2) * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
        luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
        return F.when(F.length(digits).between(13, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind int, start, stop, value, before>> of a non-null text, by kind as in KINDS, then start."""

    def of_kind(number: int, kind: str) -> Column:
        needed = (text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)) & (F.lit(kind == "email") | text.rlike("[0-9]"))
        passing = F.filter(_found(text, PATTERNS[kind]), lambda s: _passes(kind, s["value"]))
        return F.when(needed, F.transform(passing, lambda s: _as_kind(number, s))).otherwise(F.array().cast(_NO_SPANS))

    return F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])


def bootstrapped(seeds: DataFrame, unseen: DataFrame) -> DataFrame:
    """Identifiers to accept (kind, before, value), from seeds and unseen identifiers of the same columns, both distinct.

    A pattern (kind, before) that a trusted identifier stands in has the mean score of its identifiers as its confidence,
    if SUPPORT of them are trusted; seeds score 1, unseen ones at first 0. An unseen identifier's score is one minus the
    product of its patterns' doubts, rounded. Scores only rise, so rounds end. Accepted are identifiers of a trusted score in
    their places after patterns of a trusted confidence. Seeds count once, by pattern, before the rounds; a round groups by
    pattern and by identifier, and its scores are stored, so Spark knows their size and shuffles no more than it has to.
    """
    trusted = seeds.groupBy("kind", "before").agg(F.count("*").alias("n"))
    trusted = trusted.select("kind", "before", F.col("n").cast("double").alias("sum"), F.col("n").alias("trusted"), "n")
    scores, seen = None, None
    while True:
        held = unseen.withColumn("score", F.lit(0.0))
        if scores is not None:
            held = unseen.join(scores, ["kind", "value"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        one = held.select("kind", "before", F.col("score").alias("sum"), (F.col("score") >= TRUSTED).cast("long").alias("trusted"), F.lit(1).cast("long").alias("n"))
        sums = one.unionByName(trusted).groupBy("kind", "before").agg(F.sum("sum").alias("sum"), F.sum("trusted").alias("trusted"), F.sum("n").alias("n"))
        good = sums.where(F.col("trusted") >= SUPPORT).select("kind", "before", F.least(F.col("sum") / F.col("n"), F.lit(0.999)).alias("confidence"))
        now = scores and scores.agg(F.count("*"), F.bit_xor(F.xxhash64("kind", "value", "score"))).first()
        if scores is not None and now == seen:
            accepted = held.where(F.col("score") >= TRUSTED).join(good.where(F.col("confidence") >= TRUSTED), ["kind", "before"])
            return accepted.select("kind", "before", "value")
        seen = now
        doubt = unseen.join(good, ["kind", "before"]).groupBy("kind", "value").agg(F.exp(F.sum(F.log(1 - F.col("confidence")))).alias("doubt"))
        scores = stored(doubt.select("kind", "value", F.round(1 - F.col("doubt"), DECIMALS).alias("score")))


def free_of_base(spans: str) -> Column:
    """Those of the array column ``spans`` that overlap none of the column ``base``; in one order by start, from both ends."""
    place = lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), i.alias("i"))
    events = F.array_sort(F.concat(F.transform("base", lambda s: place(s, F.lit(-1))), F.transform(spans, place)))
    flags = F.array().cast("array<boolean>")
    ahead = running(events, F.lit(0), flags, lambda at, e: F.when(e["i"] < 0, F.greatest(at, e["stop"])).otherwise(at), lambda at, e: at > e["start"])
    behind = running(F.reverse(events), F.lit(2**31 - 1), flags, lambda at, e: F.when(e["i"] < 0, F.least(at, e["start"])).otherwise(at), lambda at, e: at < e["stop"])
    marked = F.zip_with(events, F.zip_with(ahead, F.reverse(behind), lambda a, b: a | b), lambda e, bad: F.when((e["i"] >= 0) & ~bad, e["i"]))
    kept = F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.get(spans, i))
    return F.when(F.size("base") == 0, F.col(spans)).otherwise(kept)


def contextual(scanned: DataFrame) -> DataFrame:
    """New spans (row, kind, start, stop), given rows (row, base, keys, tokens): the seeds of secrets and what they and the
    base matches lead to. None overlaps a base span of its row."""

    fields = ("kind", "start", "stop", "value", "before")
    rows = scanned.where(F.size("tokens") > 0)
    tokens = rows.select("row", F.explode(free_of_base("tokens")).alias("t")).select("row", *[f"t.{f}" for f in fields]).where("before != ''")
    keys = scanned.where(F.size("keys") > 0).select("row", F.explode(free_of_base("keys")).alias("t")).select("row", *[f"t.{f}" for f in fields])
    seeds = scanned.select(F.explode(F.concat("base", "keys")).alias("s")).select("s.kind", "s.before", "s.value").where("before != ''").distinct()
    seeds = stored(seeds)
    unseen = stored(tokens.select("kind", "before", "value").distinct().join(seeds, ["kind", "before", "value"], "left_anti"))
    new = tokens.join(bootstrapped(seeds, unseen), ["kind", "before", "value"])
    return new.select("row", "kind", "start", "stop").union(keys.select("row", "kind", "start", "stop"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): a row for each input row (doc_id, text); spans are structs (kind number, start, stop).

    Null and empty texts have no spans. Time is linear in the length of a text. Repeated rows each keep their row; equal
    identifiers of one kind count once as seeds however often they are repeated. ``added`` never overlaps ``base``; a place
    may be an identifier of several kinds there. Other columns are ignored; an empty table gives an empty result.
    """
    scanned = scan(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    added = contextual(scanned).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("added"))
    found = scanned.select("row", "doc_id", places("base").alias("base")).join(added, "row", "left")
    return found.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,stop:int>>")).alias("added"))


def places(spans: str | Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with base, keys (seeds of secrets) and tokens (candidates) instead of text; written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [c for c in docs.columns if c != "text"]
    return settle(docs.select(*others, base_spans(text).alias("base"), secrets(text).alias("keys"), candidates(text).alias("tokens")))


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    none = F.array().cast("array<struct<from:int,to:int,kind:int,fresh:boolean>>")
    cuts = running(
        ordered,
        F.lit(0),
        none,
        lambda at, s: F.greatest(at, s["stop"]),
        lambda at, s: F.struct(at.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"), (s["start"] >= at).alias("fresh")),
    )

    def piece(some: Column) -> Column:
        """The text up to the last of some cuts; it is cut out first, so that places are counted in it alone."""
        low, high = F.get(some, F.lit(0))["from"], F.element_at(some, -1)["to"]
        one = F.transform(F.array(text.substr(low + 1, high - low)), lambda part: F.array_join(F.transform(some, lambda c: F.concat(part.substr(c["from"] - low + 1, c["to"] - c["from"]), F.get(name, c["kind"]))), ""))
        return F.get(one, F.lit(0))

    end = F.array_max(F.transform(spans, lambda s: s["stop"]))
    whole = F.concat(F.array_join(F.transform(blocks(F.filter(cuts, lambda c: c["fresh"])), piece), ""), text.substr(end + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns (a column n_chars follows its text) with all personal data in ``text`` replaced.

    A null text stays null. Rows that are equal in doc_id and text, repeated ones too, get the same spans. Other columns,
    whatever their names, are handed on. An empty table gives an empty result. Only the spans that the method adds are stored and
    joined by id and text, and those are few; base spans are found again beside the text, so that no text is shuffled for them.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("h"))
    added = contextual(scan(docs.select(key.alias("row"), "text")))
    kind = "array<struct<kind:int,start:int,stop:int>>"
    added = stored(added.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "stop")).cast(kind).alias("added")))
    joined = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("row")).join(added, "row", "left")
    base = places(base_spans(F.coalesce("doc.text", F.lit("")))).cast(kind)
    found = joined.select("doc", F.array_union(base, F.coalesce("added", F.array().cast(kind))).alias("spans"))
    done = F.when(F.col("doc.text").isNotNull(), redacted(F.col("doc.text"), F.col("spans")))
    changed = {"text": done}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(done).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def _is_kind(number: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == number


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(both).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(both).cast("long").alias("n_spans")
    )
