"""Secret scan with DataFrame functions only: base patterns and sliding-window entropy."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,rank:int,start:int,end:int>>"

# The three base kinds, in the order in which ties on start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharClass:
    """A character class: its alphabet, what a candidate string must hold besides (lookaheads), and the least bits a character."""

    name: str
    alphabet: str
    needs: str
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("hex", DIGITS + "abcdef" + "ABCDEF", r"(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
    CharClass("base64", UPPER + LOWER + DIGITS + "+/_-", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.7),
    CharClass("base36", LOWER + DIGITS, r"(?=.*[0-9])(?=.*[g-z])", 3.5),
    CharClass("base32", UPPER + DIGITS, r"(?=.*[0-9])(?=.*[G-Z])", 3.5),
    CharClass("letters", UPPER + LOWER, r"(?=.*[a-z][A-Z])(?=.*[A-Z][a-z])", 3.8),
)
#: Candidates that fit one of these in whole are no secrets: placeholders, documented examples, UUIDs, one repeated character.
ALLOW = (r".*EXAMPLE.*", r".*(?i:placeholder|changeme|your[_-]).*", r"(.)\1*", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Folds that collect an array run over blocks of so many elements, since each step copies what it has collected.
BLOCK = 256
#: Counts are kept as characters from here on, one for each letter of the alphabet.
ZERO = 48
MAX_WINDOW = 200


def bind(value: Column, use) -> Column:
    """use(value), with `value` evaluated once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(numbers: Column) -> Column:
    """The sum of the elements up to and including each one. Blocks first, so that the work is linear in practice."""
    sums = lambda xs, first: F.aggregate(
        xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")), lambda acc: acc["out"]
    )

    def whole(xs: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(begins, lambda b: F.slice(xs, b, F.lit(BLOCK)))
        ends = lambda bs: sums(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return bind(blocks, lambda bs: bind(ends(bs), lambda es: F.flatten(F.transform(bs, lambda b, i: sums(b, F.when(i == 0, F.lit(0)).otherwise(F.get(es, i - 1)))))))

    return F.when(F.size(numbers) <= BLOCK, sums(numbers, F.lit(0))).otherwise(whole(numbers))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, hit, part): code-point position, match and the group's text. The
    pieces between matches and the matches alternate, so a running sum of their lengths gives each place."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    pairs = F.arrays_zip(found(0).alias("hit"), F.split(text, pattern, -1).alias("gap"), found(group).alias("part"))
    of = lambda ps: bind(
        F.filter(ps, lambda p: p["hit"].isNotNull()),
        lambda qs: bind(
            running_sum(F.transform(qs, lambda p: F.length(p["gap"]) + F.length(p["hit"]))),
            lambda ends: F.transform(qs, lambda p, i: F.struct((F.get(ends, i) - F.length(p["hit"])).alias("start"), p["hit"].alias("hit"), p["part"].alias("part"))),
        ),
    )
    return F.when(text.rlike(pattern), bind(pairs, of)).otherwise(F.array().cast("array<struct<start:int,hit:string,part:string>>"))


def spans_of(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["start"].alias("start"), (m["start"] + F.length(m["hit"])).alias("end")))


def base_spans(text: Column) -> Column:
    """The base findings, by start and then by kind as listed."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= 6)
    return in_order(F.concat(spans_of(assign, "assign", 0), spans_of(matches(text, ACCESS), "access", 1), spans_of(matches(text, HEX), "hex", 2)))


def in_order(spans: Column) -> Column:
    """By start, then by rank, each span once."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    once = bind(ordered, lambda xs: F.filter(xs, lambda s, i: (i == 0) | (s != F.get(xs, i - 1))))
    return F.transform(once, lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))


def merged(spans: Column, touching: bool) -> Column:
    """[start, end) of the spans' union, in order; touching ones are joined if `touching`. With starts and ends each in
    order, a part of the union ends where as many spans have ended as have begun."""

    def cut(starts: Column, ends: Column) -> Column:
        apart = lambda end, start: end < start if touching else end <= start
        heads = F.filter(starts, lambda s, i: (i == 0) | apart(F.get(ends, i - 1), s))
        tails = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | apart(e, F.get(starts, i + 1)))
        return F.arrays_zip(heads.alias("start"), tails.alias("end"))

    in_turn = lambda xs, field: F.array_sort(F.transform(xs, lambda s: s[field]))
    return bind(spans, lambda xs: bind(in_turn(xs, "start"), lambda starts: bind(in_turn(xs, "end"), lambda ends: cut(starts, ends))))


RUNS = "array<struct<start:int,end:int>>"


def most_sum(window: int, bits: float) -> int:
    """The greatest sum of c*log2(c), in units of 2**-32, of a window whose entropy is at least `bits`."""
    return int(window * (math.log2(window) - bits + 1e-9) * (1 << 32))


def window_runs(candidate: Column, alphabet: Column, window: int, most: Column) -> Column:
    """Merged [start, end) runs of the windows of `window` characters whose sum of c*log2(c) is at most `most`.

    One pass: a count for each letter of the alphabet and the sum of c*log2(c), as integers so that nothing drifts; a
    step takes off the leaving letter and adds the entering one, so entropy = log2(window) - sum/window needs no recount.
    Windows go in blocks of BLOCK, each with its own fold, so time and memory are linear in the candidate. Callers
    bind the columns.
    """
    weights = F.lit([round(c * math.log2(c) * (1 << 32)) if c else 0 for c in range(window + 2)]).cast("array<bigint>")
    count = lambda counts, letter: F.ascii(F.substring(counts, letter, F.lit(1))) - ZERO
    put = lambda counts, letter, c: F.overlay(counts, F.char(c + ZERO), letter, F.lit(1))
    weight = lambda c: F.get(weights, c)

    def note(acc: Column, end: Column, first: Column) -> list[Column]:
        """What the window that ends at `end` (its sum is in `acc`) does to the open run and the runs before it."""
        high = (end >= first + window) & (acc["total"] <= most)
        fresh = high & (acc["end"] < end - window)
        closed = F.array_append(acc["runs"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return [
            F.when(fresh & (acc["end"] >= 0), closed).otherwise(acc["runs"]).alias("runs"), F.when(fresh, end - window).otherwise(acc["start"]).alias("start"),
            F.when(high, end).otherwise(acc["end"]).alias("end"),
        ]

    def step(acc: Column, x: Column, first: Column) -> Column:
        counts, enter, leave = acc["counts"], x["enter"], x["leave"]
        more, less = count(counts, enter), count(counts, leave)
        added = weight(more + 1) - weight(more)
        return F.struct(
            F.when(leave.isNull(), put(counts, enter, more + 1)).when(enter == leave, counts).otherwise(put(put(counts, leave, less - 1), enter, more + 1)).alias("counts"),
            F.when(leave.isNull(), acc["total"] + added).when(enter == leave, acc["total"]).otherwise(acc["total"] + added + weight(less - 1) - weight(less)).alias("total"),
            *note(acc, x["at"], first),
        )

    def block(letters: Column, first: Column) -> Column:
        last = F.least(F.size(letters), first + BLOCK + window - 1)
        moves = F.transform(
            F.sequence(first, last - 1),
            lambda i: F.struct(i.alias("at"), F.get(letters, i).alias("enter"), F.when(i >= first + window, F.get(letters, i - window)).alias("leave")),
        )
        zero = F.struct(
            F.repeat(F.lit(chr(ZERO)), F.length(alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.array().cast(RUNS).alias("runs"), F.lit(-1).alias("start"), F.lit(-1).alias("end")
        )
        noted = F.aggregate(moves, zero, lambda acc, x: step(acc, x, first), lambda acc: F.struct(*note(acc, last, first)))
        return bind(noted, lambda r: F.when(r["end"] < 0, r["runs"]).otherwise(F.array_append(r["runs"], F.struct(r["start"].alias("start"), r["end"].alias("end")))))

    letters = F.transform(F.slice(F.split(candidate, ""), F.lit(1), F.length(candidate)), lambda x: F.instr(alphabet, x))
    blocks = lambda xs: F.flatten(F.transform(F.sequence(F.lit(0), F.size(xs) - window, F.lit(BLOCK)), lambda first: block(xs, first)))
    return merged(bind(letters, blocks), touching=True)


def _letters(alphabet: str) -> str:
    return "".join("\\" + x if x in "-/+" else x for x in alphabet)


def entropy_spans(text: Column, classes: tuple[CharClass, ...] = CLASSES, window: int = 20, allow: tuple[str, ...] = ALLOW, rank: int = 3) -> Column:
    """Spans of kind entropy: in each maximal run of a class of at least `window` characters, what high windows cover.
    A run that an allow pattern fits in whole is suppressed. The text is searched once, for runs of all classes' letters."""
    if not 1 < window <= MAX_WINDOW:
        raise ValueError(f"a window has 2 to {MAX_WINDOW} characters")

    every = "".join(sorted({x for c in classes for x in c.alphabet}))
    if not every:
        return F.array().cast(SPAN)
    alphabets, limits = F.array(*(F.lit(c.alphabet) for c in classes)), F.array(*(F.lit(most_sum(window, c.bits)).cast("bigint") for c in classes))

    def of_class(k: int, c: CharClass, outer: Column) -> Column:
        needed = F.filter(matches(outer["hit"], f"[{_letters(c.alphabet)}]{{{window},}}"), lambda m: m["hit"].rlike("^" + c.needs))
        return F.transform(needed, lambda m: F.struct(F.lit(k).alias("nth"), (outer["start"] + m["start"]).alias("start"), m["hit"].alias("hit")))

    def allowed(m: Column) -> Column:
        fits = F.lit(False)
        for a in allow:
            fits = fits | m["hit"].rlike(f"^(?:{a})$")
        return fits

    def runs(m: Column) -> Column:
        found = window_runs(m["hit"], F.get(alphabets, m["nth"]), window, F.get(limits, m["nth"]))
        return F.transform(found, lambda r: F.struct(F.lit("entropy").alias("kind"), F.lit(rank).alias("rank"), (m["start"] + r["start"]).alias("start"), (m["start"] + r["end"]).alias("end")))

    outer = matches(text, f"[{_letters(every)}]{{{window},}}")
    candidates = F.flatten(F.transform(outer, lambda m: F.concat(*(of_class(k, c, m) for k, c in enumerate(classes)))))
    return F.flatten(F.transform(F.filter(candidates, lambda m: ~allowed(m)), runs))


def scan(docs: DataFrame, window: int = 20, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Add `base` and `spans` (arrays of kind, rank, start, end in code points, end exclusive) to every document.

    Null text is empty and has no spans; rows, ties and further columns are kept as they are. Base findings stay even
    where the allow-list fits; the method's own spans (kind entropy) are added to them. Columns of docs named base or
    spans are replaced. Row-wise: no shuffle; time is linear in the text, however long a candidate is.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_base = docs.withColumn("base", base_spans(text))
    return with_base.withColumn("spans", in_order(F.concat("base", entropy_spans(text, classes, window, allow))))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mask: str = "****") -> DataFrame:
    """The documents of scan() with every span (merged where they overlap) replaced by `mask`; columns base and spans go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = 4096

    def between(blocks: Column, start: Column, end: Column) -> Column:
        """The code points from `start` to before `end`, without walking the text from its beginning."""
        first, last = F.floor(start / wide).cast("int"), F.floor(end / wide).cast("int")
        head = lambda n: F.substring(F.get(blocks, first), start - first * wide + 1, n)
        inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.coalesce(head(end - start), F.lit(""))).otherwise(F.concat(head(F.lit(wide)), inner, F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end - last * wide), F.lit(""))))

    def kept(blocks: Column, gone: Column, size: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1)["end"])
        pieces = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: between(blocks, begin(i), F.when(i == F.size(gone), size).otherwise(F.get(gone, i)["start"])))
        return F.array_join(pieces, mask)

    cut = lambda blocks, gone, size: bind(blocks, lambda bs: bind(gone, lambda gs: bind(size, lambda n: kept(bs, gs, n))))
    masked = cut(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{wide}}}"), F.lit(0)), merged(F.col("spans"), touching=False), F.length(text))
    return docs.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))).drop("base", "spans")
