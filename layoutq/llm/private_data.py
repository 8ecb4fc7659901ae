"""Personal data: high-recall generators propose overlapping spans, boosted trees choose among them.

Base spans follow fixed formats and always stay. Generators with looser formats propose further spans (a phone number that runs
into another number, a card next to an address, an address with its dots in brackets). Small boosted trees score each proposal that overlaps no base span by format
and context features; per-kind thresholds, calibrated on proposals that the trees didn't see, select what is added. Of accepted
proposals of one kind the one that contains others stays.

What the trees learn from doesn't come from the base spans: into ``SAMPLE`` contexts of up to ``WIDTH`` characters (the text with the least hash of each of as many
buckets, so that copies and sources have no more weight than others) seeded personal data and look-alikes are planted, whose truth is known; a proposal there
is right where it is exactly a planted true span. That table has a fixed size, whatever the corpus; half of the contexts trains, the other half calibrates.
Everything on the data is built-in functions: one small aggregate of contexts, then one projection over all texts, no user code.

Patterns are possessive where that can't change a match, and start at the previous match's end or outside a run, so that a text of any length costs linear time.

Edge cases: null and empty texts have no spans (hash of the empty string); repeated rows and ids each get their row, as nothing is
joined by id; extra columns pass through ``redacted``; an empty table gives an empty result (its trees learn from planted spans without context).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read

KINDS = ("email", "ip", "card", "phone")
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?+"
IP = rf"^(?=[0-9]){_PART}\.(?=[0-9]){_PART}\.(?=[0-9]){_PART}\.(?=[0-9]){_PART}$"
#: The formats of the contract, and what a text must contain for them.
BASE = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]"),
    (r"[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]"),
    (r"\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]"),
)
#: kind's place, looser format, what a text must contain.
GENERATORS = (
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}+[A-Za-z]{2,24}+", "@"),
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+){1,8}+", "[\\[(]at[\\])]"),
    (1, r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])", "[0-9]\\.[0-9]"),
    (1, r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])", "\\[\\.\\][0-9]"),
    (1, r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])", "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    (2, r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "[0-9]{13}"),
    (2, r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])", "[0-9]{4}[ -][0-9]{4}"),
    (3, r"(?<![0-9+])\+[0-9]{1,3}+[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])", "\\+[0-9]"),
    (3, r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}"),
    (3, r"(?<![0-9+])\+[0-9]{1,3}+(?:[ .-][0-9]{2,4}){3,5}(?![0-9])", "\\+[0-9]"),
)
SPAN = "array<struct<k:int,s:int,e:int,m:string>>"


def spans_of(text: Column, kind: int, pattern: str, needs: str) -> Column:
    """All matches of a pattern in order, with code point offsets: the gaps come from split, the matches from extraction."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("k"), start.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    return F.when(text.contains("@") if needs == "@" else text.rlike(needs), F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]).otherwise(none)


def luhn_sum(digits: Column) -> Column:
    r = F.reverse(digits)
    total = lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c) - 48))
    plain, doubled = F.regexp_replace(r, "(.).?", "$1"), F.translate(F.regexp_replace(r, ".(.?)", "$1"), "0123456789", "0246813579")
    return total(plain) + total(doubled)


def luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[ -]", "")
    return F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(False)


def valid(kind: int, match: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return match.rlike(IP)
    return luhn(match) if kind == 2 else F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)


def proposed(df: DataFrame, text: str = "text", base: str = "base", more: str = "proposals") -> DataFrame:
    """df with the valid base spans, and with those proposals of the generators that no base span overlaps, each with its features."""
    t = F.coalesce(F.col(text), F.lit(""))
    checked = lambda k: lambda x: valid(k, x["m"])
    found = [F.filter(spans_of(t, k, p, needs), checked(k)) for k, (p, needs) in enumerate(BASE)]
    df = df.withColumn(base, F.concat(*found)).withColumn(more, F.concat(*[spans_of(t, k, p, needs) for k, p, needs in GENERATORS]))
    free = F.filter(F.array_distinct(more), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return df.withColumn(more, F.transform(free, lambda x: F.struct(*[x[c].alias(c) for c in "kse"], vector(t, x).alias("v"))))


FEATURES = ("kind", "length", "digits", "separators", "plus", "parenthesis", "dashed", "luhn", "octets", "ending", "before", "after", "letters", "numbered", "addressed", "coded")


def vector(t: Column, x: Column) -> Column:
    """Binned format and context features of a proposal, as an array of small integers in the order of FEATURES."""
    m = x["m"]
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    bin_of = lambda c, *cuts: sum(((c >= v).cast("int") for v in cuts), F.lit(0))
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\x09-\x0D ]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"[A-Za-z]"), 3).otherwise(4)
    head = F.lower(F.substring(t, F.greatest(x["s"] - 11, F.lit(1)), F.least(x["s"], F.lit(12))))
    return F.array(
        x["k"], bin_of(x["e"] - x["s"], 10, 13, 16, 20, 40), bin_of(digits, 1, 7, 9, 13, 16, 17, 20), bin_of(F.length(F.regexp_replace(m, "[^ ().-]", "")), 1, 2, 4, 6),
        m.contains("+").cast("int"), m.contains("(").cast("int"), m.rlike("[0-9][.-][0-9]").cast("int"), luhn(m).cast("int"), F.coalesce(F.regexp_replace(m, r"[\[\]]", "").rlike(IP), F.lit(False)).cast("int"),
        m.rlike(r"(?:\.|[\])] ?)(?:com|org|net|edu|gov|info|io|example|de|fr|es|uk)$").cast("int"),
        F.when(x["s"] == 0, 0).otherwise(side(F.substring(t, x["s"], 1))), side(F.substring(t, x["e"] + 1, 1)), bin_of(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), 1, 4, 16),
        head.rlike("version|build|rev|isbn|issn|doi|part|ref|serial|order|no\\.|#").cast("int"), head.rlike("call|tel|phone|fax|card|visa|mail|contact|host|server").cast("int"), head.rlike("\\+[0-9]{1,3}[ .-]?$").cast("int"),
    )


SAMPLE, WIDTH, PLANTED = 2048, 240, 4


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """b from 0 to SAMPLE - 1, and a piece of a text for each: of the one with the least hash in this bucket, empty where there is none."""
    t, h = F.col(text), F.xxhash64(text)
    at = F.pmod(h, F.greatest(F.length(t) - WIDTH, F.lit(1)).cast("long")).cast("int") + 1
    found = docs.where(F.length(t) > 0).select(F.pmod(F.xxhash64(h), F.lit(SAMPLE)).alias("b"), F.struct(h.alias("h"), F.substring(t, at, F.lit(WIDTH)).alias("c")).alias("x"))
    found = found.groupBy("b").agg(F.min("x").alias("x"))
    return docs.sparkSession.range(SAMPLE).select(F.col("id").alias("b")).join(found, "b", "left").select("b", F.coalesce("x.c", F.lit("")).alias("c"))


def specimens(seed: int) -> list[Column]:
    """Personal data and look-alikes, made of hashes of b and of a card number: kind, whether it is right, what stands before it, itself, what stands after it."""
    hashed = lambda k: F.xxhash64(F.col("b"), F.lit(seed), F.lit(k))
    number = lambda k, n: F.lpad(F.pmod(hashed(k), F.lit(10**n)).cast("string"), n, "0")
    one_of = lambda k, *names: F.get(F.lit(list(names)), F.pmod(hashed(k), F.lit(len(names))).cast("int"))
    octet = lambda k: F.pmod(hashed(k), F.lit(256)).cast("string")
    joined_by = lambda sep, *parts: F.concat_ws(sep, *parts)
    card, no_card = F.col("card"), F.concat(F.substring("card", 1, 15), ((F.substring("card", 16, 1).cast("int") + 3) % 10).cast("string"))
    area, local, line = number(2, 3), number(3, 3), number(4, 4)
    ip = joined_by(".", *[octet(k) for k in (5, 6, 7, 8)])
    name, host = F.concat(one_of(9, "anna", "jo.lee", "m_kim", "sales", "info"), one_of(10, "", "", "7", "42")), one_of(11, "mail.example", "example", "post4", "host-a.example")
    call, bank = one_of(12, "", "call ", "tel ", "phone "), one_of(12, "", "card ", "visa ", "")
    groups = F.regexp_replace(card, "(....)(....)(....)(....)", one_of(13, "$1 $2 $3 $4", "$1-$2-$3-$4"))
    none, space = F.lit(""), F.lit(" ")
    made = [
        (3, True, call, F.concat(F.lit("+1 ("), area, F.lit(") "), local, F.lit("-"), line), F.concat(space, card)),
        (3, True, none, F.concat(F.lit("+1 ("), area, F.lit(") "), local, F.lit("-"), line), F.concat(space, ip)),
        (3, True, call, F.concat(F.lit("("), area, F.lit(") "), local, F.lit("-"), line), none),
        (3, True, call, joined_by("-", area, local, line), none),
        (3, True, call, joined_by(".", area, local, line), none),
        (3, False, one_of(14, "part no. ", "ref ", "serial #"), joined_by("-", area, local, line), none),
        (3, False, F.concat(number(15, 4), space), joined_by(" ", area, local, line), F.concat(space, number(16, 3))),
        (2, True, bank, card, F.concat(space, ip)),
        (2, True, F.concat(number(17, 2), space), card, none),
        (2, True, F.concat(ip, space), card, none),
        (2, True, bank, groups, F.concat(space, number(17, 2))),
        (2, False, none, no_card, F.concat(space, ip)),
        (2, False, F.concat(one_of(18, "a", "7f", "c0e"), none), card, one_of(20, "f", "be1", "d")),
        (2, False, one_of(18, "order ", "at "), F.concat(F.lit("17"), number(19, 11)), F.concat(space, number(17, 2))),
        (0, True, none, F.concat(name, one_of(21, " [at] ", "[at]", " (at) ", "(at)"), host, one_of(22, " [dot] com", "(dot)org", ".net", ".com")), none),
        (0, False, none, F.concat(one_of(21, "us", "them", "it"), F.lit(" (at) "), one_of(22, "noon", "home", "auction"), one_of(23, ". Then", ". The", ".So")), none),
        (0, False, none, F.concat(one_of(21, "vec", "row", "items"), F.lit("[at]"), one_of(22, "i.next", "first.value", "k.size")), none),
        (1, True, one_of(24, "", "host ", "server "), joined_by("[.]", *[octet(k) for k in (5, 6, 7, 8)]), none),
        (1, True, none, joined_by(":", *[F.lower(F.hex(F.pmod(hashed(k), F.lit(65536)))) for k in range(30, 38)]), none),
        (1, False, one_of(24, "version ", "", "build "), joined_by(".", F.concat(F.lit("9"), number(25, 2)), *[one_of(k, "1", "0", "12", "204") for k in (5, 6, 7)]), none),
        (1, False, none, joined_by(":", *[number(k, 2) for k in range(30, 38)]), none),
    ]
    return [F.struct(F.lit(k).alias("k"), F.lit(right).alias("right"), pre.alias("pre"), span.alias("span"), post.alias("post")) for k, right, pre, span, post in made]


def planted(found: DataFrame, seed: int = 1) -> DataFrame:
    """half, v, y for every proposal that touches a planted span: its features, and whether it is exactly that and true."""
    made, body = specimens(seed), F.concat(F.lit("4"), F.lpad(F.pmod(F.xxhash64("b", F.lit(seed)), F.lit(10**14)).cast("string"), 14, "0"))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    x = found.repartition(8, "b").withColumn("card", card).withColumn("made", F.array(*made))
    which = F.array(*[F.pmod(F.floor(F.col("b") / 2) * PLANTED + j, F.lit(len(made))).cast("int") for j in range(PLANTED)])
    x = x.select("b", "c", F.explode(F.transform(which, lambda k: F.get("made", k))).alias("z"))
    left, right = F.substring("c", 1, WIDTH // 2), F.substring("c", WIDTH // 2 + 1, WIDTH)
    text = F.concat(left, F.lit(" "), F.col("z.pre"), F.col("z.span"), F.col("z.post"), F.lit(" "), right)
    x = x.select("b", "z", text.alias("text"), (F.length(left) + 1 + F.length("z.pre")).alias("s")).withColumn("e", F.col("s") + F.length("z.span"))
    x = proposed(x).select("b", "z.k", "z.right", "s", "e", F.explode("proposals").alias("x")).where((F.col("x.s") < F.col("e")) & (F.col("x.e") > F.col("s")))
    y = F.col("right") & (F.col("x.k") == F.col("k")) & (F.col("x.s") == F.col("s")) & (F.col("x.e") == F.col("e"))
    return x.select((F.col("b") % 2).alias("half"), F.col("x.v").alias("v"), y.cast("int").alias("y"))


class Trees:
    """Boosted depth-two trees on counts per feature vector, with a threshold for each kind."""

    def __init__(self, rounds: int = 24, rate: float = 0.5, precision: float = 0.9):
        self.rounds, self.rate, self.precision = rounds, rate, precision
        self.trees: list[tuple] = []
        self.thresholds: dict[int, float] = {}
        self.start = 0.0

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple | None:
        best = None
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[1:]:
                right = x[rows, j] >= cut
                gain = 0.0
                for side in (right, ~right):
                    gain += g[rows][side].sum() ** 2 / (h[rows][side].sum() + 1.0)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, int(cut))
        return best

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Trees:
        """x: vectors; n, y: how many proposals and how many right ones each has."""
        if not len(x):
            return self
        share = (y.sum() + 1) / (n.sum() + 2)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(x), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - n * p, n * p * (1 - p)
            every = np.arange(len(x))
            top = self._split(x, g, h, every)
            if top is None:
                break
            leaves = []
            for side in (0, 1):
                rows = every[(x[:, top[1]] >= top[2]) == bool(side)]
                low = self._split(x, g, h, rows)
                parts = [rows] if low is None else [rows[x[rows, low[1]] < low[2]], rows[x[rows, low[1]] >= low[2]]]
                values = [float(self.rate * g[r].sum() / (h[r].sum() + 1.0)) for r in parts]
                for r, v in zip(parts, values, strict=True):
                    f[r] += v
                leaves.append((None if low is None else low[1:], values))
            self.trees.append((top[1:], leaves))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for (j, cut), leaves in self.trees:
            for side in (0, 1):
                at = (x[:, j] >= cut) == bool(side)
                low, values = leaves[side]
                f[at] += values[0] if low is None else np.where(x[at][:, low[0]] >= low[1], values[-1], values[0])
        return f

    def calibrate(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Trees:
        """Per kind the lowest score from which held-out proposals are right often enough, all together, and at each score more often than not."""
        f = self.raw(x)
        for kind in range(len(KINDS)):
            own = np.flatnonzero(x[:, 0] == kind) if len(x) else []
            right = seen = 0.0
            for score in sorted({round(float(f[i]), 9) for i in own}, reverse=True):
                at = [i for i in own if round(float(f[i]), 9) == score]
                right, seen = right + y[at].sum(), seen + n[at].sum()
                if 2 * y[at].sum() < n[at].sum():
                    break
                if right >= self.precision * seen:
                    self.thresholds[kind] = score - 1e-6
        return self

    def column(self, v: Column) -> Column:
        total = F.lit(self.start)
        for (j, cut), leaves in self.trees:
            sides = [F.lit(values[0]) if low is None else F.when(F.get(v, low[0]) >= low[1], values[-1]).otherwise(values[0]) for low, values in leaves]
            total = total + F.when(F.get(v, j) >= cut, sides[1]).otherwise(sides[0])
        return total

    def accepts(self, x: Column) -> Column:
        """Whether a proposal passes its kind's threshold."""
        ok, score = F.lit(False), self.column(x["v"])
        for kind, least in self.thresholds.items():
            ok = ok | ((x["k"] == kind) & (score >= least))
        return ok


def learned(docs: DataFrame, text: str = "text", seed: int = 1) -> Trees:
    """Trees and thresholds, fitted on the driver to counts per feature vector of what was planted: SAMPLE * PLANTED texts, so a bounded number."""
    counts = planted(contexts(docs, text), seed).groupBy("half", "v").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    rows = sorted(counts.collect(), key=lambda r: (r["half"], r["v"]))
    parts = []
    for h in (0, 1):
        own = [r for r in rows if r["half"] == h]
        parts.append((np.array([r["v"] for r in own], dtype=int).reshape(len(own), len(FEATURES)), np.array([r["n"] for r in own], dtype=float), np.array([r["y"] for r in own], dtype=float)))
    return Trees().fit(*parts[0]).calibrate(*parts[1])


def chosen(trees: Trees, base: str = "base", more: str = "proposals") -> Column:
    """Base spans and accepted proposals, by kind and start; of accepted ones of a kind that contain one another the longest."""
    bare = lambda x: F.struct(*[x[c].alias(c) for c in "kse"])
    added = F.transform(F.filter(more, trees.accepts), bare)
    within = lambda x, y: (x["k"] == y["k"]) & (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])
    outer = F.transform(F.array(added), lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: within(x, y))))[0]
    return F.sort_array(F.array_distinct(F.concat(F.transform(base, bare), outer)))


def joined(spans: Column) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = learned(docs)
    spans = proposed(docs)
    of = lambda k: lambda x: x["k"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.sort_array(F.transform("base", lambda x: F.struct(*[x[c].alias(c) for c in "kse"])))
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(chosen(trees)).alias("spans"), F.size("proposals").alias("n_proposals"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every chosen span of text replaced by its kind in angle brackets; overlapping spans give one mark, of the first."""
    names = docs.columns
    key, base, more, mark = free_names(docs, "spans", "base", "more", "mark")
    x = proposed(docs, base=base, more=more)
    x = x.withColumn(key, F.sort_array(F.transform(chosen(learned(docs.select("text")), base, more), lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["k"].alias("k")))))
    text, kinds = F.col("text"), F.lit(list(KINDS))

    def step(acc: Column, s: Column) -> Column:
        marked = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["s"] - acc["at"]), F.lit("<"), F.get(kinds, s["k"]), F.lit(">"))
        return F.struct(F.when(s["s"] >= acc["at"], marked).otherwise(acc["out"]).alias("out"), F.greatest(s["e"], acc["at"]).alias("at"))

    done = F.aggregate(key, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    x = x.withColumn(mark, F.when(F.size(key) > 0, done))
    d = F.col(mark)
    clean = F.when(F.size(key) > 0, F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))).otherwise(text)
    return x.select(*[clean.alias(n) if n == "text" else F.col(f"`{n}`") for n in names])
