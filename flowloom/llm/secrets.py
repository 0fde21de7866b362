"""Secret scans: strong patterns, and weak candidates that complementary parts beside them confirm.

Method: a pattern is run over a whole text; the text between its matches gives their places.
Three strong kinds (assign, access, hex) are reported wherever they stand.  Weak candidates
are no findings by themselves: short values of a secret's name, values of other credential
names, and long runs of digits and letters of both cases.  They are linked with access identifiers (user and
account names, client and key ids) and endpoints (addresses with a scheme, hosts) by an interval
join: both parts lie in one scope, a stretch of text without a blank line, and within REACH
characters of each other.  A candidate is reported, as `linked`, only with an identifier and
an endpoint, or with an access key, beside it; one secret never confirms another.

The join is by cells of REACH characters in a text.  A part takes a few characters at least,
so a cell holds a bounded number of parts in texts of any length, and no text meets in one task
beyond the list of its own spans.  Only column functions, joins and aggregates are used.

Defined results: null and empty texts have no spans, digests are those of the empty list;
candidates that overlap a strong span are not reported again, nor is a candidate that begins
inside an earlier one; repeated rows get equal results each; an empty table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.stage import materialize

#: Characters between two parts at most, and the kinds in their listed order.
REACH = 256
KINDS = ("assign", "access", "hex", "linked")


def any_case(names: str) -> str:
    """The names in either case, of ASCII letters only."""
    return "".join(f"[{c}{c.upper()}]" if "a" <= c <= "z" else c for c in names)


# The strong patterns and the lengths they ask for.  Possessive repeats change no match, they keep the search linear.
_NAME = any_case("password|passwd|secret|token|api_?key")
_BOUND = r"""["']?+\x20*+[:=]\x20*+["']?+"""
ASSIGN = rf"({_NAME}){_BOUND}([A-Za-z0-9+/_.=-]++)"
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"
ASSIGN_CHARS = 12
# Names of weak parts.
_WEAK_NAME = any_case("passphrase|passcode|pwd|credentials?|auth_?key|access_?key|private_?key|secret_?key|account_?key|shared_?key|signature")
_ID_NAME = any_case("user_?name|user_?id|user|login|account_?name|account_?id|account|client_?id|key_?id|tenant_?id|tenant|principal")
_HOST_NAME = any_case("host_?name|host|endpoint|server|url|registry|bucket")
_SCHEME = any_case("https?|ftp|ssh|ldaps?|amqps?|rediss?|mongodb|postgres|postgresql|mysql")
#: Weak candidates: values of at least six characters behind a name, and runs of 20 or more with digits and both cases.
WEAK = rf"(?:{_NAME}|{_WEAK_NAME}){_BOUND}[A-Za-z0-9+/_.=!@#$%^&*-]{{6,}}+"
MIXED = "[A-Za-z0-9+/_-]{20,}+={0,2}"
MIXED_NEEDS = ("[0-9]", "[a-z]", "[A-Z]")
IDENTIFIER = rf"(?:{_ID_NAME}){_BOUND}[A-Za-z0-9._@+-]{{2,}}+"
ENDPOINT = rf"(?:(?:{_SCHEME})://[A-Za-z0-9._~:@%-]{{3,}}+|(?:{_HOST_NAME}){_BOUND}[A-Za-z0-9._:-]{{3,}}+)"
#: Signs of an identifier or an endpoint; a text without one, and without an access key, is not searched for weak parts.
HINT = rf"://|(?:{_ID_NAME}|{_HOST_NAME}){_BOUND}[A-Za-z0-9]"
BLANK_LINE = r"\n[ \t\r]*+\n"
STRONG = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
PARTS = {"weak": WEAK, "mixed": MIXED, "identifier": IDENTIFIER, "endpoint": ENDPOINT, "blank": BLANK_LINE}
SPAN = "array<struct<start:int,end:int>>"


#: Matches whose places are summed up in one go; longer lists are summed chunk by chunk, so their cost stays nearly linear.
CHUNK = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walked(steps: Column, first: Column) -> Column:
    """(start, end, match) of matches whose gaps and sizes begin at `first`."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("spans"))

    return F.aggregate(steps, F.struct(first.alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def _placed(steps: Column) -> Column:
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))

    def offsets(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda own: F.aggregate(own, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["match"])))
        sums = F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
        return _bound(sums, lambda firsts: F.flatten(F.transform(chunks, lambda own, k: _walked(own, F.get(firsts, k)))))

    return _bound(chunks, offsets)


def places(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """(start, end) in code points of the leftmost non-overlapping matches; then those whose text does not pass `keep` are dropped."""

    def spans(found: Column) -> Column:
        # the text between the matches tells where they are; behind the last gap there is none
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
        every = _bound(steps, _placed)
        passed = every if keep is None else F.filter(every, lambda s: keep(s["match"]))
        named = F.transform(passed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when(F.size(found) > 0, named).otherwise(F.array().cast(SPAN))

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _tagged(spans: Column, kind: str) -> Column:
    """(start, order, end, kind), which sorts by start and listed kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def parts(docs: DataFrame) -> DataFrame:
    """Per row, written: number, doc_id, strong spans by kind, weak candidates, identifiers, endpoints, blank lines."""
    text = F.col("text")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast(SPAN)
    long_value = lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_CHARS
    mixed = lambda match: reduce(Column.__and__, [match.rlike(need) for need in MIXED_NEEDS])
    weak = lambda pattern, keep=None: F.when(F.col("hinted"), places(text, pattern, keep)).otherwise(none)
    keyed = F.contains(text, F.lit("AKIA"))
    return materialize(
        slim.withColumn("hinted", keyed | text.rlike(HINT)).select(
            "row",
            "doc_id",
            places(text, ASSIGN, long_value).alias("assign"),
            F.when(keyed, places(text, ACCESS)).otherwise(none).alias("access"),
            places(text, HEX).alias("hex"),
            *[weak(pattern, mixed if role == "mixed" else None).alias(role) for role, pattern in PARTS.items()],
        ),
        "secret-spans",
    )


def linked(found: DataFrame) -> DataFrame:
    """(row, linked): weak candidates beside their complements, by the interval join."""
    some = found.filter((F.size("weak") + F.size("mixed") > 0) & (F.size("identifier") + F.size("endpoint") + F.size("access") > 0))
    roles = {"weak": "candidate", "mixed": "candidate", "identifier": "identifier", "endpoint": "endpoint", "access": "access", "blank": "blank", "assign": "strong", "hex": "strong"}
    each = [some.select("row", F.lit(role).alias("role"), F.explode(column).alias("at")).select("row", "role", "at.start", "at.end") for column, role in roles.items()]
    # scopes: blank lines before a part; strong spans and earlier candidates: the furthest end before it
    before = Window.partitionBy("row").orderBy("start", F.col("role") != "strong", "end", "role").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    strong = F.col("role").isin("strong", "access")
    marked = reduce(DataFrame.unionByName, each).distinct().withColumns(
        {
            "scope": F.coalesce(F.sum((F.col("role") == "blank").cast("int")).over(before), F.lit(0)),
            "covered": F.max(F.when(strong, F.col("end"))).over(before),
            "next": F.min(F.when(strong, F.col("start"))).over(after),
        }
    )
    marked = materialize(marked.filter("role not in ('blank', 'strong')"), "secret-parts")
    free = (F.coalesce(F.col("covered"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    candidates = marked.filter((F.col("role") == "candidate") & free).select("row", "scope", "start", "end")
    cell = lambda c: F.floor(F.col(c) / REACH)
    reached = candidates.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - REACH) / REACH), F.floor((F.col("end") + REACH) / REACH))))
    others = marked.filter("role <> 'candidate'").select("row", "scope", "role", F.col("start").alias("o_start"), F.col("end").alias("o_end"), cell("start").alias("cell"))
    near = (F.col("o_start") <= F.col("end") + REACH) & (F.col("o_end") >= F.col("start") - REACH) & ((F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end")))
    pairs = reached.join(others, ["row", "scope", "cell"]).filter(near)
    has = lambda role: F.max((F.col("role") == role).cast("int")) == 1
    sure = pairs.groupBy("row", "start", "end").agg((has("access") | (has("identifier") & has("endpoint"))).alias("sure")).filter("sure")
    # of overlapping candidates the first stays
    earlier = F.max("end").over(Window.partitionBy("row").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1))
    first = sure.withColumn("earlier", earlier).filter(F.coalesce(F.col("earlier"), F.lit(0)) <= F.col("start"))
    return first.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("linked"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row of `docs`."""
    found = parts(docs)
    more = materialize(linked(found), "linked-secrets")
    base = F.array_sort(F.concat(*[_tagged(F.col(k), k) for k in KINDS[:3]]))
    both = found.join(more, "row", "left").withColumn("linked", F.coalesce("linked", F.array().cast(SPAN))).withColumn("base", base)
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return both.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", _tagged(F.col("linked"), "linked")))).alias("spans"),
        count("linked"),
    )
