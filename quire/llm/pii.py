"""Personal data by weak supervision, in built-in functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Looser candidates
(national phone numbers, social-security-like numbers, names after a title) are judged: three labelers
vote on every span, base ones included: the strict form (regex), a gazetteer, and words that stand before it
(context). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is;
its posteriors are the soft labels of a logistic span classifier over votes and form, whose weights are
compiled into a Spark expression. Candidates that it gives at least one half are added.

Places are code points, end exclusive. A null text is empty. The votes of all documents are counted; what
reaches the driver is a table of vote and form patterns, whose size is bounded by construction. Rows are
judged one by one, so ties, repeated rows and further columns need no special case.

Places come from splitting a text at the matches: the pieces' lengths and the matches' lengths add up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

# Possessive forms of the base patterns: the same matches, without backtracking on long runs. A match may
# start inside a run of its characters only where the match before it has ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
SSN = r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|[.-][0-9])"
NAME = r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}{1,20}\x20\p{Lu}\p{Ll}{1,20}(?![\p{L}\p{N}])"

BASE = ("email", "ip", "card", "phone")

# The default gazetteers (callers give their own as ``Lists``) and the words of the context labeler.
GIVEN_NAMES = (
    "Alejandro Alexander Alice Amélie Ana Andrea Andrew Angela Anna Anne Antonio Antoine Barbara Ben Brigitte Camille Carlos Carmen Caroline Charles Charlotte Christian "
    "Christine Claire Claudia Daniel David Diego Dorothy Eduardo Elena Elisabeth Elizabeth Emily Emma Eric Eva Fernando François Frank Frédéric George Hans Heinrich Helen Henry "
    "Isabel Isabelle Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Johann John Jorge José Joseph Juan Julia Julien Jürgen Karen Karl Katharina Klaus Laura Lena Léa "
    "Linda Lisa Louis Louise Lucas Lucía Luis Lukas Manuel Manuela Marc Margaret Maria Marie Mark Markus Martin Mary Matthew Maximilian Michael Michel Miguel Monika Nancy Nicolas "
    "Olivia Pablo Patricia Patrick Paul Pedro Peter Petra Philippe Pierre Rafael Richard Robert Rosa Sabine Sandra Sarah Sébastien Sofía Sophie Stefan Stephen Steven Susan Susanne "
    "Thomas Ursula Valentina Victor Walter William Wolfgang"
).split()
MAIL_ENDINGS = "com org net edu gov mil int io co info biz app dev de fr es uk it nl ch at be pt pl se no dk fi ie eu us ca mx br ar cl jp cn in au nz ru za".split()


@dataclass(frozen=True)
class Lists:
    """The gazetteers of the second labeler."""

    given_names: tuple[str, ...] = tuple(GIVEN_NAMES)
    mail_endings: tuple[str, ...] = tuple(MAIL_ENDINGS)


LISTS = Lists()
CUES = r"(?i)(?:phone|tel|call|mobile|fax|contact|reach|e-?mail|write|address|server|host|ip|card|visa|payment|ssn|social security|insurance|name|signed|dear|appel|téléphone|anruf|telefon|llama|teléfono)[^\n]{0,24}$"
COUNTER_CUES = r"(?i)(?:order|invoice|ref|reference|version|isbn|serial|part no|ticket|total|section|page|chapter)[^\n]{0,12}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def weight(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 0, twice).otherwise(x)

    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weight(i))
    return n.between(13, 19) & (F.when(n.between(13, 19), total % 10).otherwise(1) == 0)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "\\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without it has no match
    valid: object = None
    base: bool = True


KINDS = (
    Kind("email", EMAIL, "@"),
    Kind("ip", IP, "[0-9]\\.[0-9]+\\.[0-9]+\\.", _octets),
    Kind("card", CARD, "[0-9](?:[\\x20-]?[0-9]){12}", _luhn),
    Kind("phone", PHONE, "\\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)),
    Kind("phone", LOCAL_PHONE, "[0-9]{3}[.-][0-9]{4}", None, False),
    Kind("ssn", SSN, "[0-9]{3}-[0-9]{2}-[0-9]{4}", None, False),
    Kind("name", NAME, "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\\.?\\x20", None, False),
)
#: Order of kinds in the output.
RANK = ("email", "ip", "card", "phone", "ssn", "name")

_SPAN = "array<struct<kind:string,start:long,end:long,value:string,before:string,base:boolean>>"


BLOCK = 256


def running(values: Column, f, zero: int) -> Column:
    """``f`` of all numbers up to each one, in blocks: a fold that grows an array copies it at every step, so none may grow long."""

    def fold(x: Column) -> Column:
        start = F.struct(F.lit(zero).cast("long").alias("now"), F.array().cast("array<bigint>").alias("all"))

        def step(acc: Column, v: Column) -> Column:
            now = f(acc["now"], v.cast("long"))
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(x, start, step, lambda acc: acc["all"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), lambda i: fold(F.slice(v, i, F.lit(BLOCK))))

    def joined(inside: Column) -> Column:
        ends = fold(F.transform(inside, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(zero).cast("long"))))
        before = F.concat(F.array(F.lit(zero).cast("long")), ends)
        return F.flatten(F.zip_with(inside, F.slice(before, 1, F.size(inside)), lambda b, o: F.transform(b, lambda x: f(o, x))))

    # one-element arrays keep what is used twice made once
    return F.get(F.transform(F.transform(F.array(values), blocks), joined), F.lit(0))


def _spans(t: Column, k: Kind) -> Column:
    """Valid matches of one kind with their places and the 48 characters before each."""
    matches = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
    pieces = F.split(t, k.pattern, -1)
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    # where each match ends: a running sum over lengths, then one span for each match
    ends = running(F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, b: a + b, 0)

    def span(x: Column, end: Column) -> Column:
        return F.struct(
            F.lit(k.name).alias("kind"), (end - F.length(x["m"])).cast("long").alias("start"), end.alias("end"),
            x["m"].alias("value"), F.right(x["p"], F.lit(48)).alias("before"), F.lit(k.base).alias("base"),
        )

    found = F.zip_with(pairs, ends, span)
    if k.valid:
        found = F.filter(found, lambda s: k.valid(s["value"]))
    has = F.contains(t, F.lit(k.needs)) if k.needs == "@" else t.rlike(k.needs)
    return F.when(has, found).otherwise(F.array().cast(_SPAN))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, loose): base spans, and candidates that overlap none of them or of each other's kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    base = F.concat(*[_spans(F.col("t"), k) for k in KINDS if k.base])
    loose = F.concat(*[_spans(F.col("t"), k) for k in KINDS if not k.base])
    out = slim.select("doc_id", base.alias("base"), loose.alias("loose"))
    few = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    many = (F.size("loose").cast("long") * F.size("base")) > BLOCK * BLOCK
    return out.withColumn("loose", F.when(F.size("loose") == 0, F.col("loose")).when(many, _apart(F.col("base"), F.col("loose"))).otherwise(few))


def _apart(base: Column, loose: Column) -> Column:
    """Loose spans that overlap no base span: of both sorted by start, the farthest base end so far and the next base start decide."""
    never = (1 << 62) - 1
    item = lambda s, side, i: F.struct(s["start"].alias("at"), F.lit(side).alias("side"), s["end"].alias("end"), i.cast("int").alias("i"))
    items = F.sort_array(F.concat(F.transform(base, lambda b, i: item(b, 0, i)), F.transform(loose, lambda c, i: item(c, 1, i))))

    def free(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: F.when(x["side"] == 0, x["end"]).otherwise(0)), F.greatest, 0)
        comes = F.reverse(running(F.transform(F.reverse(s), lambda x: F.when(x["side"] == 0, x["at"]).otherwise(never)), F.least, never))
        bounds = F.zip_with(reach, comes, lambda r, c: F.struct(r.alias("reach"), c.alias("comes")))
        places = F.zip_with(s, bounds, lambda x, b: F.when((x["side"] == 1) & (b["reach"] <= x["at"]) & (b["comes"] >= x["end"]), x["i"]))
        return F.sort_array(F.array_compact(places))

    kept = F.get(F.transform(F.array(items), free), F.lit(0))
    return F.transform(kept, lambda i: F.get(loose, i))


def votes(s: Column, lists: Lists = LISTS) -> dict[str, Column]:
    """Votes of the three labelers on a span (1 yes, -1 no, 0 none) and its form, in few values each."""
    v, kind = s["value"], s["kind"]
    say = lambda pattern: F.when(v.rlike(pattern), 1).otherwise(-1)
    strict = (
        F.when(kind == "email", say("^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\\.[A-Za-z]{2,}$"))
        .when(kind == "ip", say("^(?:0|[1-9][0-9]*)(?:\\.(?:0|[1-9][0-9]*)){3}$"))
        .when(kind == "card", say("^(?:[0-9]{13,19}|[0-9]{4}(?:[\\x20-][0-9]{4}){3}|[0-9]{4}[\\x20-][0-9]{6}[\\x20-][0-9]{5})$"))
        .when((kind == "phone") & s["base"], say("^\\+[1-9]"))
        .when(kind == "ssn", F.when(v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1).otherwise(-1))
        .when(kind == "phone", F.when(v.rlike("^\\(?[2-9][0-9]{2}\\)?[\\x20.-][2-9]"), 1).otherwise(-1))
        .otherwise(0)
    )
    gazetteer = (
        F.when(kind == "name", F.when(F.element_at(F.split(v, "\\x20"), -2).isin(list(lists.given_names)), 1).otherwise(0))
        .when(kind == "email", F.when(F.element_at(F.split(v, "\\."), -1).isin(list(lists.mail_endings)), 1).otherwise(0))
        .when((kind == "ip") & v.rlike("^(?:0|127|255)\\."), -1)
        .when((kind == "card") & v.rlike("^[3-6]"), 1)
        .otherwise(0)
    )
    context = F.when(s["before"].rlike(COUNTER_CUES), -1).when(s["before"].rlike(CUES), 1).otherwise(0)
    width = F.when(F.length(v) < 12, "short").when(F.length(v) < 20, "middle").otherwise("long")
    return {"regex": strict, "gazetteer": gazetteer, "context": context, "form": F.concat(kind, F.lit("/"), width)}


LABELERS = ("regex", "gazetteer", "context")


def count_patterns(found: DataFrame, lists: Lists = LISTS) -> list[tuple[tuple[int, int, int], str, int]]:
    """(votes, form, spans) of all spans: at most 27 vote patterns for each of 18 forms."""
    one = found.select(F.explode(F.concat("base", "loose")).alias("s")).select(*[c.alias(n) for n, c in votes(F.col("s"), lists).items()])
    rows = one.groupBy(*LABELERS, "form").count().collect()
    return sorted(((r["regex"], r["gazetteer"], r["context"]), r["form"], r["count"]) for r in rows)


@dataclass(frozen=True)
class Model:
    prior: float
    yes: tuple[tuple[float, float, float], ...]  # per labeler: chance of votes -1, 0, 1 on personal data
    no: tuple[tuple[float, float, float], ...]
    weights: tuple[tuple[str, float], ...]


def fit(patterns: list[tuple[tuple[int, int, int], str, int]], rounds: int = 50) -> Model:
    """Reliabilities by expectation-maximisation, then the classifier on its posteriors."""
    prior, yes, no = 0.5, [[0.1, 0.4, 0.5]] * 3, [[0.5, 0.4, 0.1]] * 3
    by_votes: dict[tuple[int, int, int], int] = {}
    for v, _, n in patterns:
        by_votes[v] = by_votes.get(v, 0) + n

    def posterior(v: tuple[int, int, int]) -> float:
        a, b = prior, 1 - prior
        for k, x in enumerate(v):
            a *= yes[k][x + 1]
            b *= no[k][x + 1]
        return a / (a + b)

    for _ in range(rounds):
        post = {v: posterior(v) for v in by_votes}
        mass = sum(by_votes[v] * p for v, p in post.items())
        total = sum(by_votes.values())
        prior = min(0.95, max(0.05, (mass + 1) / (total + 2)))
        for table, part, start in ((yes, lambda v: post[v], (0.1, 0.4, 0.5)), (no, lambda v: 1 - post[v], (0.5, 0.4, 0.1))):
            fresh = []
            for k in range(3):
                # ten votes' weight of the starting table keeps the classes from changing places
                n = [10 * start[x] + sum(c * part(v) for v, c in by_votes.items() if v[k] == x - 1) for x in range(3)]
                fresh.append([x / sum(n) for x in n])
            table[:] = fresh
    names = [f"{n}={x}" for n in LABELERS for x in (-1, 0, 1)]
    names += sorted({f"form={f}" for _, f, _ in patterns})
    weight = dict.fromkeys(["bias", *names], 0.0)
    rows = [(["bias", *[f"{n}={x}" for n, x in zip(LABELERS, v)], f"form={f}"], posterior(v), math.log1p(c)) for v, f, c in patterns]
    for _ in range(400):
        grad = dict.fromkeys(weight, 0.0)
        for on, p, n in rows:
            err = n * (1 / (1 + math.exp(-sum(weight[x] for x in on))) - p)
            for x in on:
                grad[x] += err
        scale = sum(n for _, _, n in rows) or 1.0
        for x in weight:
            weight[x] -= 2.0 * (grad[x] / scale + 0.001 * weight[x])
    return Model(prior, tuple(map(tuple, yes)), tuple(map(tuple, no)), tuple(weight.items()))


def score(s: Column, model: Model, lists: Lists = LISTS) -> Column:
    """The classifier's log-odds as one expression."""
    w, v = dict(model.weights), votes(s, lists)
    out = F.lit(w["bias"])
    for n in LABELERS:
        out = out + F.when(v[n] == 1, w[f"{n}=1"]).when(v[n] == -1, w[f"{n}=-1"]).otherwise(w[f"{n}=0"])
    for k, x in w.items():
        if k.startswith("form="):
            out = out + F.when(v["form"] == k[5:], x).otherwise(0.0)
    return out


def _joined(spans: Column) -> Column:
    one = lambda kind: F.transform(F.sort_array(F.transform(F.filter(spans, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(F.concat(*[one(k) for k in RANK]), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lists: Lists = LISTS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (the spans as structs)."""
    found = materialise(extract(docs, doc_id, text), "candidates")  # spans alone; extracted once
    model = fit(count_patterns(found, lists))
    added = F.filter("loose", lambda s: score(s, model, lists) >= 0.0)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.concat("base", added)
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"), every.alias("found"),
    )
