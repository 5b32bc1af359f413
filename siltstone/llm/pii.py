"""Personal data: fixed patterns, and boosted trees over further candidates; DataFrame and SQL functions throughout.

Generators with high recall propose spans that may overlap.  Each has a few format and context features of small
range, none of which tells the fixed patterns' own marks (a plus, an at sign).  Candidates at a fixed pattern's match
are examples, ill-formed ones (a card without its checksum) are counterexamples, and well-formed ones elsewhere are
what is to be decided: they teach nothing.  The corpus is summed up as how often every combination of features is
either; these counts, whose number is bounded by the features' ranges, are all that the driver sees.  It boosts trees
on them and picks each kind's threshold on held-out documents for a wanted precision.  The trees are applied as a SQL
sum.

Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.durable import written

KINDS = ("email", "ip", "card", "phone")
#: Characters for private use that stand for separators and marks while matching; a text's own ones become '?'.
SEP, DOT, MARK = "\ue000", "\ue001", "\ue002"
#: The base patterns, written without groups that repeat (those would use the stack for long matches)
#: and without starts inside a run. SEP is a space or hyphen, DOT a dot, between two characters of the classes.
BASE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]+@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": rf"(?<![0-9{SEP}])[0-9](?:{SEP}?[0-9]){{13,18}}(?![0-9{SEP}])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates. The bounds are those of the formats: 64 characters before the sign, domains of up to 127 labels of 63.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|[ ]?[(\[](?:at|AT)[)\]][ ]?)[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[(\[](?:dot|DOT)[)\]][ ]?)[A-Za-z0-9-]{1,63}){1,126}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Words before a span that hint at it.
HINTS = {
    "email": "mail|contact|contacto|kontakt|courriel|correo|schreib|write to",
    "ip": "ip|host|server|address|adresse|direcci",
    "card": "card|visa|credit|karte|carte|tarjeta|amex",
    "phone": "phone|tel|call|fax|mobile|handy|anruf|appel|llam|móvil",
}
#: Ranges of the features: values are 0 to n - 1.
FEATURES = {"f_kind": 4, "f_valid": 2, "f_shape": 4, "f_before": 5, "f_after": 5, "f_hint": 2}
#: So many different combinations there can be, and rows that the driver gets at most, twice over.
MOST_CELLS = 4 * 2 * 4 * 5 * 5 * 2


def _masked(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), SEP + DOT + MARK, "???")


def _found(t: Column, pattern: str, kind: str) -> Column:
    """Parts of the text: between matches at even places, matches at odd places."""
    needed = {"email": t.contains("@") | t.contains("(") | t.contains("["), "ip": t.contains("."), "phone": F.lit(True), "card": F.lit(True)}[kind]
    return F.when(needed, F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(F.array(t))


def _blocks(text: str) -> str:
    """SQL of the text in blocks of 4096 characters, the last one shorter or empty: taking parts of a long text from its
    start on would cost the square of its length."""
    return f"transform(sequence(0, cast(length(coalesce({text}, '')) div 4096 as int)), b -> substring(coalesce({text}, ''), b * 4096 + 1, 4096))"


def _piece(blocks: str, a: str, e: str) -> str:
    """SQL of the text from a to e."""
    first, last = f"cast(({a}) div 4096 as int)", f"cast(({e}) div 4096 as int)"
    inside = f"substring({blocks}[{first}], cast(({a}) % 4096 as int) + 1, cast(({e}) - ({a}) as int))"
    over = f"concat(substring({blocks}[{first}], cast(({a}) % 4096 as int) + 1, 4096), array_join(slice({blocks}, {first} + 2, greatest({last} - {first} - 1, 0)), ''), substring({blocks}[{last}], 1, cast(({e}) % 4096 as int)))"
    return f"if({first} = {last}, {inside}, {over})"


def _spans(parts: str) -> Column:
    """(start, end, text) of the matches; prefix sums by blocks of 128, so that many matches don't cost their square."""
    return F.expr(f"""
        transform(filter(sequence(0, greatest(size({parts}) - 1, 0)), i -> i % 2 = 1), i -> named_struct(
            'start', {parts}_before[i div 128] + aggregate(slice({parts}_sizes, cast(i div 128 as int) * 128 + 1, i % 128), 0L, (a, x) -> a + x),
            'end', {parts}_before[i div 128] + aggregate(slice({parts}_sizes, cast(i div 128 as int) * 128 + 1, i % 128 + 1), 0L, (a, x) -> a + x),
            'text', {parts}[i]))""")


def _with_spans(df: DataFrame, of: dict[str, Column]) -> DataFrame:
    """Adds a column of spans for each column of parts."""
    kept = df.columns
    df = df.withColumns({f"{c}_parts": x for c, x in of.items()})
    df = df.withColumns({f"{c}_parts_sizes": F.expr(f"transform({c}_parts, x -> cast(length(x) as bigint))") for c in of})
    df = df.withColumns({f"{c}_parts_blocks": F.expr(f"transform(sequence(0, (size({c}_parts) - 1) div 128), j -> aggregate(slice({c}_parts_sizes, cast(j as int) * 128 + 1, 128), 0L, (a, x) -> a + x))") for c in of})
    df = df.withColumns({f"{c}_parts_before": F.expr(f"transform(sequence(0, size({c}_parts_blocks) - 1), j -> aggregate(slice({c}_parts_blocks, 1, j), 0L, (a, x) -> a + x))") for c in of})
    return df.select(*kept, *(_spans(f"{c}_parts").alias(c) for c in of))


LUHN = """(aggregate(sequence(1, length({d})), 0L, (a, i) -> a + case when i % 2 = 1 then cast(substr(reverse({d}), i, 1) as int)
    else (cast(substr(reverse({d}), i, 1) as int) * 2) div 10 + (cast(substr(reverse({d}), i, 1) as int) * 2) % 10 end) % 10 = 0)"""
OCTETS = "forall(split({t}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(nullif(ltrim('0', p), '') as int), 0) <= 255)"
DIGITS = "translate(lower({t}), 'abcdefghijklmnopqrstuvwxyz +-().@_%[]" + SEP + DOT + "', '')"


def base_spans(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds the base spans: kind, start and end, sorted by start, then kind as in KINDS.

    Null and empty texts have none; texts of any length are read whole; a column of the name `out` is replaced, all
    others are carried; repeated rows are independent.
    """
    own = "siltstone_pii_"
    kept = [c for c in df.columns if c != out]
    t = F.col(f"{own}text")
    dotted = F.when(t.contains("@"), F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)).otherwise(F.lit(""))
    joined = F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", SEP)
    found = {f"{own}{k}": _found({"email": dotted, "card": joined}.get(k, t), BASE[k], k) for k in KINDS}
    df = _with_spans(df.select(*kept, _masked(text).alias(f"{own}text")), found).drop(f"{own}text")
    good = {
        "email": "true",
        "ip": OCTETS.format(t="s.text"),
        "card": LUHN.format(d=DIGITS.format(t="s.text")),
        "phone": f"length({DIGITS.format(t='s.text')}) between 10 and 15",
    }
    every = ", ".join(f"transform(filter({own}{k}, s -> {good[k]}), s -> named_struct('start', s.start, 'rank', {n}, 'kind', '{k}', 'end', s.end))" for n, k in enumerate(KINDS))
    return df.select(*kept, F.expr(f"transform(array_sort(concat({every})), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))").alias(out))


def candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Adds the candidate spans with their features, by start, then kind.

    Null and empty texts have none; texts of any length are read whole; a column of the name `out` is replaced, all
    others are carried; repeated rows are independent.
    """
    own = "siltstone_pii_"
    kept = [c for c in df.columns if c != out]
    t = F.col(f"{own}text")
    df = _with_spans(df.select(*kept, _masked(text).alias(f"{own}text")), {f"{own}{k}": _found(t, CANDIDATES[k], k) for k in KINDS})
    df = df.withColumns({f"{own}blocks": F.expr(_blocks(f"{own}text")), f"{own}size": F.expr(f"cast(length({own}text) as bigint)")})
    side = "case when {c} = '' then 0 when {c} rlike '[0-9]' then 1 when {c} rlike '[\\\\p{{L}}_]' then 2 when {c} rlike '\\\\s' then 3 else 4 end"
    valid = {
        "email": "element_at(split(s.text, '[.)\\\\]]'), -1) rlike '^ ?[A-Za-z]{2,10}$'",
        "ip": OCTETS.format(t="s.text"),
        "card": LUHN.format(d=DIGITS.format(t="s.text")),
        "phone": f"length({DIGITS.format(t='s.text')}) between 10 and 15",
    }
    shape = {
        "email": "case when s.text rlike '^[A-Za-z]+[._-][A-Za-z]+[^A-Za-z._-]' then 0 when s.text rlike '^[0-9]' then 1 when s.text rlike '^[A-Za-z0-9]+[^A-Za-z0-9]' then 2 else 3 end",
        "ip": "case when s.text like '0%' then 1 when s.text like '127.%' or s.text like '10.%' or s.text like '192.168.%' then 2 else 0 end",
        "card": "case when length(s.text) = 16 then 0 when s.text rlike '[ ]' then 1 when s.text rlike '-' then 2 else 3 end",
        "phone": "case when contains(s.text, '(') then 0 when s.text like '%-%-%' then 1 when contains(s.text, '.') then 2 else 3 end",
    }

    def one(n: int, k: str) -> str:
        ahead = _piece(f"{own}blocks", "greatest(s.start - 24, 0L)", "s.start")
        before = _piece(f"{own}blocks", "greatest(s.start - 1, 0L)", "s.start")
        after = _piece(f"{own}blocks", f"least(s.end, {own}size)", f"least(s.end + 1, {own}size)")
        return f"""transform({own}{k}, s -> named_struct('start', s.start, 'rank', {n}, 'kind', '{k}', 'end', s.end, 'f_kind', {n},
            'f_valid', cast({valid[k]} as int), 'f_shape', {shape[k]}, 'f_before', {side.format(c=before)}, 'f_after', {side.format(c=after)},
            'f_hint', cast(lower({ahead}) rlike '(?:{HINTS[k]})' as int)))"""

    every = ", ".join(one(n, k) for n, k in enumerate(KINDS))
    return df.select(*kept, F.expr(f"array_sort(concat({every}))").alias(out))


@dataclass
class Trees:
    """Boosted trees as (feature, value, left, right) with "feature <= value" to the left, or a leaf's number; a threshold for each kind."""

    trees: list = field(default_factory=list)
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, row: dict[str, int]) -> float:
        total = self.bias
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return 1 / (1 + math.exp(-total))

    def sql(self, s: str) -> str:
        def one(t) -> str:  # noqa: ANN001
            return f"if({s}.{t[0]} <= {t[1]}, {one(t[2])}, {one(t[3])})" if isinstance(t, tuple) else f"{t!r}D"

        return f"1 / (1 + exp(-({' + '.join([f'{self.bias!r}D', *map(one, self.trees)])})))"

    def chosen(self, s: str) -> str:
        """SQL of whether the candidate is well-formed, as whatever is at a base span is, and reaches the threshold of its kind."""
        return "(case " + " ".join(f"when {s}.kind = '{k}' then {s}.f_valid = 1 and {self.sql(s)} >= {t!r}D" for k, t in self.thresholds.items()) + " else false end)" if self.thresholds else "false"


def boost(cells: list[tuple[dict[str, int], float, float]], rounds: int = 30, depth: int = 3, rate: float = 0.4, shrink: float = 1.0) -> Trees:
    """Newton boosting of logistic loss over cells: (features, how often positive, how often negative)."""
    pos, neg = sum(p for _, p, _ in cells), sum(n for _, _, n in cells)
    model = Trees(bias=math.log((pos + 1) / (neg + 1)))
    margin = [model.bias] * len(cells)

    def leaf(rows: list[int]) -> tuple[float, float]:
        g = h = 0.0
        for k in rows:
            q = 1 / (1 + math.exp(-margin[k]))
            _, p, n = cells[k]
            g += p - (p + n) * q
            h += (p + n) * q * (1 - q)
        return g, h

    def grow(rows: list[int], d: int):  # noqa: ANN202
        g, h = leaf(rows)
        best = (1e-6, None)
        if d:
            for f, width in FEATURES.items():
                for v in range(width - 1):
                    left = [k for k in rows if cells[k][0][f] <= v]
                    if 0 < len(left) < len(rows):
                        gl, hl = leaf(left)
                        gain = gl * gl / (hl + shrink) + (g - gl) ** 2 / (h - hl + shrink) - g * g / (h + shrink)
                        if gain > best[0]:
                            best = (gain, (f, v, left))
        if best[1] is None:
            step = rate * g / (h + shrink)
            for k in rows:
                margin[k] += step
            return step
        f, v, left = best[1]
        inside = set(left)
        return f, v, grow(left, d - 1), grow([k for k in rows if k not in inside], d - 1)

    if pos and neg:
        for _ in range(rounds):
            model.trees.append(grow(list(range(len(cells))), depth))
    return model


def fit(found: DataFrame, precision: float = 0.9, base: str = "base", proposed: str = "candidates", prior: float = 1.0) -> Trees:
    """Learns from the candidates at base spans of their kind, and from ill-formed ones.

    Three quarters of the rows (by hash of their spans) train; the others set each kind's threshold: from it on, the
    share of those at base spans is at least `precision`, and it lies halfway to the scores of which that isn't so, or
    at 0.5 at most where there are none.  A kind whose best held-out candidates are ill-formed adds nothing; one
    without held-out candidates takes the threshold 0.5, and scores that the kinds share.  prior: how many examples and
    counterexamples of each kind are added to those of the corpus, so that the smallest corpus has scores.
    """
    near = f"exists({base}, b -> b.kind = c.kind and b.start < c.end and c.start < b.end)"
    told = f"transform(filter({proposed}, c -> {near} or c.f_valid = 0), c -> named_struct({', '.join(f'{f!r}, c.{f}' for f in FEATURES)}, 'hit', {near}))"
    rows = found.select(F.pmod(F.xxhash64(F.col(base).cast("string"), F.col(proposed).cast("string")), F.lit(4)).alias("part"), F.expr(f"explode({told})").alias("c"))
    cells = rows.groupBy((F.col("part") == 3).alias("held"), *(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(F.sum(F.col("c.hit").cast("long")).alias("pos"), F.count("*").alias("n")).collect()
    split = lambda held: [({f: r[f] for f in FEATURES}, float(r.pos), float(r.n - r.pos)) for r in cells if r.held == held]
    # what is known without a corpus: of each kind, well-formed spans between spaces are examples, ill-formed ones aren't
    known = [({"f_kind": n, "f_valid": v, "f_shape": 0, "f_before": 3, "f_after": 3, "f_hint": h}, prior * v, prior * (1 - v)) for n in range(len(KINDS)) for v in (0, 1) for h in (0, 1)]
    model = boost(split(False) + known)
    for n, kind in enumerate(KINDS):
        scored = sorted(((model.score(x), p, q) for x, p, q in split(True) if x["f_kind"] == n), key=lambda x: -x[0])
        model.thresholds[kind] = 2.0 if scored else 0.5
        pos = neg = 0.0
        for k, (s, p, q) in enumerate(scored):
            pos, neg = pos + p, neg + q
            if pos >= precision * (pos + neg) and (k + 1 == len(scored) or scored[k + 1][0] < s):
                model.thresholds[kind] = (s + scored[k + 1][0]) / 2 if k + 1 < len(scored) else min(s, 0.5)
    return model


def select(found: DataFrame, model: Trees, out: str = "spans", base: str = "base", proposed: str = "candidates") -> DataFrame:
    """Adds all spans: the base ones, and the candidates over their threshold that overlap none of their kind.

    A null or empty list of candidates adds nothing; a column of the name `out` is replaced, all others are carried,
    those of the base and the candidates too.
    """
    free = f"filter({proposed}, c -> not exists({base}, b -> b.kind = c.kind and b.start < c.end and c.start < b.end) and {model.chosen('c')})"
    added = F.expr(f"transform({free}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))")
    ranks = " ".join(f"when s.kind = '{k}' then {n}" for n, k in enumerate(KINDS))
    order = f"transform(array_sort(transform(concat({base}, siltstone_pii_added), s -> named_struct('start', s.start, 'rank', case {ranks} end, 'kind', s.kind, 'end', s.end))), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
    kept = [c for c in found.columns if c != out]
    return found.withColumn("siltstone_pii_added", added).select(*kept, F.expr(order).alias(out))


def written_form(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Puts [KIND] for each span (spans that overlap count as one, of the first's kind); null texts stay null.

    Running maxima go by blocks of 128 spans, and pieces of text are taken from blocks of 4096 characters, so that long
    texts with many spans don't cost the square of their length.
    """
    own, kept = "siltstone_redact_", df.columns
    some = f"{own}n > 0 and `{text}` is not null"
    steps = [
        {"s": f"transform(array_sort(transform({spans}, s -> named_struct('start', s.start, 'last', s.`end`, 'kind', s.kind))), s -> s)"},
        {"n": f"size({own}s)", "t": _blocks(f"`{text}`")},
        {"b": f"case when {some} then transform(sequence(0, cast(({own}n - 1) div 128 as int)), j -> array_max(transform(slice({own}s, j * 128 + 1, 128), s -> s.last))) end"},
        {"p": f"transform({own}b, (x, j) -> coalesce(array_max(slice({own}b, 1, j)), 0L))"},
        # the greatest end before each span, and at last the greatest of all; the outer array is computed once
        {"r": f"case when {some} then concat(flatten(transform({own}p, (p, j) -> transform(slice({own}s, j * 128 + 1, 128), (s, i) -> greatest(p, coalesce(array_max(transform(slice({own}s, j * 128 + 1, i), x -> x.last)), 0L))))), array(array_max({own}b))) end"},
        {"k": f"case when {some} then filter(sequence(0, {own}n - 1), i -> {own}s[i].start >= {own}r[i]) end"},
        {"m": f"transform({own}k, (i, k) -> named_struct('kind', {own}s[i].kind, 'start', {own}s[i].start, 'last', {own}r[if(k + 1 < size({own}k), {own}k[least(k + 1, size({own}k) - 1)], {own}n)]))"},
    ]
    for step in steps:
        df = df.withColumns({f"{own}{c}": F.expr(e) for c, e in step.items()})

    before = f"if(k = 0, 0L, {own}m[greatest(k - 1, 0)].last)"
    body = f"array_join(transform({own}m, (m, k) -> concat({_piece(f'{own}t', before, 'm.start')}, '[', upper(m.kind), ']')), '')"
    tail = _piece(f"{own}t", f"element_at({own}m, -1).last", f"cast(length(`{text}`) as bigint)")
    done = F.expr(f"case when {some} then concat({body}, {tail}) else `{text}` end")
    return df.withColumn(text, done).select(*kept)


def find(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with `base` and `spans` of every row; the text is read once.

    Null and empty texts have no spans; repeated rows count as often as they occur; an empty table gives no rows.
    Carried columns of the names `base`, `candidates` and `spans` are replaced, columns that aren't carried are dropped.
    """
    found = written(candidates(base_spans(df.select(*carry, text), text), text).drop(text), "candidates")
    return select(found, fit(found)).drop("candidates")
