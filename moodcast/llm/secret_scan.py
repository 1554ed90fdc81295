"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Three base patterns (assignments, access keys, hexadecimal runs) are found
leftmost and without overlap. Besides, every run of 20 or more token characters
is a candidate. Its encoding is inferred (the smallest alphabet that holds it)
and three tests look at it:

* chi-squared statistic of the symbol counts against uniform counts,
* number of runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

A run that one of them finds too far from random (``FAR`` standard deviations,
either side) is structured: sequences, repetitions, few symbols. The others are
held against ordinary text. Its model is a chain over the classes lower, upper,
digit and mark, with letters by their frequency in European languages; a second
one has the cases swapped, and the likelier one counts. The likelihood of
independent uniform symbols over that of the text has mean 1 at most under the
text model, so its inverse, times the number of encodings, bounds the p-value
(Markov) at any length. Keys of 20 characters already differ clearly.

What is structured, and numbers, which text has as well, can still be found
when long: there the null hypothesis of each test is that the run is less
uniform than its effect allows, or dependent by more than ``DEPENDENCE``, and the
p-value is the largest of the three. The p-value of a run is twice the smaller
of both, or this last one alone if the run is structured. A Benjamini-Hochberg step
with weights in proportion to length, over the runs of all documents, bounds
the share of false discoveries by ``FDR``. The step needs only a histogram of the
weighted p-values (512 rows), not their order.

Work is in proportion to the text: no expression looks at the text, or at all
matches, again for each match.

All positions are code points, ends exclusive.

Defined cases: a null text is empty; empty texts have no spans; null ids stay null; repeated rows are
scanned each (and count each in the control); runs are looked for outside of
assignments, and a run that is a hex or access span is left out; an empty table gives an empty result; extra columns are kept by
``find_secrets`` unless they clash with the added ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import let, materialise, quoted, running

# the looks ahead and behind change no match; they end most attempts at the first character
ASSIGN = r"""(?i)(?=[apst])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LETTERS = 6
# a maximal run is at least so long exactly if the bounded pattern matches it
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# name, alphabet, effect: the smallest sum of squared relative deviations from
# uniform counts, for each symbol, that counts as structure
ENCODINGS: tuple[tuple[str, str, float], ...] = (
    ("decimal", DIGITS, 0.3),
    ("hex_lower", DIGITS + "abcdef", 0.4),
    ("hex_upper", DIGITS + "ABCDEF", 0.4),
    ("letters_lower", LOWER, 0.35),
    ("letters_upper", UPPER, 0.35),
    ("base32", UPPER + "234567", 0.5),
    ("base36_lower", LOWER + DIGITS, 0.5),
    ("base36_upper", UPPER + DIGITS, 0.5),
    ("base62", UPPER + LOWER + DIGITS, 0.9),
    ("base64", UPPER + LOWER + DIGITS + "+/", 0.9),
    ("base64_url", UPPER + LOWER + DIGITS + "-_", 0.9),
    ("base66", UPPER + LOWER + DIGITS + "+/-_", 0.9),
)
DEPENDENCE = 0.5
FAR = 3.5
# text: letters in percent (a to z), and the next symbol's class (lower, upper, digit,
# mark) at the start and after each class, in percent
LETTER_RATES = (8.2, 1.5, 2.9, 4.3, 14.0, 1.5, 1.8, 3.5, 7.5, 0.4, 0.8, 4.6, 2.7,
                7.6, 6.1, 2.3, 0.5, 6.6, 7.1, 6.9, 4.8, 1.3, 1.0, 0.3, 1.0, 0.7)
LETTER_FLOOR = 0.1   # share of uniform letters mixed in: names, abbreviations, other languages
CLASS_RATES = ((25, 25, 25, 25), (80, 8, 4, 8), (45, 45, 4, 6), (8, 6, 76, 10), (55, 15, 20, 10))
MARKS = "+/-_"
FDR = 0.05
BINS_PER_OCTAVE = 8
BINS = 512
MASK = "[SECRET]"

_NONE = "cast(array() as array<struct<start:int,end:int,kind:int,part:string>>)"
CUT = 1024    # code points of a piece when texts are cut at many positions


def _spans(gaps: str, parts: str, kind: int) -> str:
    """SQL: spans of ``parts``, each after one of ``gaps``."""
    ends = running(f"zip_with(slice({gaps}, 1, size({parts})), {parts}, (g, p) -> length(g) + length(p))", "{a} + {b}")
    return (f"zip_with({ends}, {parts}, (e, p) -> named_struct('start', e - length(p), 'end', e, 'kind', {kind}, 'part', p))")


def _matches(text: str, pattern: str, kind: int) -> str:
    """SQL: leftmost matches that don't overlap: array of start, end, kind and matched text."""
    q = quoted(pattern)
    return let("mf", f"regexp_extract_all({text}, {q}, 0)",
               f"if(size(mf) = 0, {_NONE}, {let('mg', f'split({text}, {q}, -1)', _spans('mg', 'mf', kind))})")


def _scan(text: str) -> str:
    """SQL: struct of ``base`` (spans of the fixed patterns, by start, then kind) and ``runs`` (candidates).

    Candidates are runs of token characters in the text with all assignments blanked, but for
    those that are a hex or access span as a whole.
    """
    q = quoted(ASSIGN)
    assign = f"filter({_spans('ag', 'af', 0)}, m -> length(regexp_extract(m.part, {q}, 2)) >= {ASSIGN_LETTERS})"
    base = f"sort_array(concat(if(size(af) = 0, {_NONE}, {assign}), {_matches('tx', ACCESS, 1)}, {_matches('tx', HEX, 2)}))"
    # zip_with's last gap has no part
    blank = "if(size(af) = 0, tx, array_join(zip_with(ag, af, (g, p) -> concat(g, coalesce(repeat(' ', length(p)), ''))), ''))"
    whole = quoted(f"^(?:{ACCESS}|{HEX})$")
    runs = let("bt", blank, f"filter({_matches('bt', RUN, KINDS.index('random'))}, m -> not m.part rlike {whole})")
    return let("tx", f"coalesce(cast({text} as string), '')",
               let("af", f"regexp_extract_all(tx, {q}, 0)",
                   let("ag", f"if(size(af) = 0, array(tx), split(tx, {q}, -1))",
                       f"named_struct('base', {base}, 'runs', {runs})")))


# Chebyshev fit of log(erfc) by Press et al., Numerical Recipes (relative error below 1.2e-7)
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
        0.17087277)


def normal_cdf(z: str) -> str:
    """SQL of the standard normal distribution function; small tails are right to 1.2e-7 of their value."""
    t = f"(1.0D / (1.0D + abs({z}) * {0.5 / math.sqrt(2)!r}D))"
    poly = f"{ERFC[-1]!r}D"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}D + {t} * {poly})"
    tail = f"(0.5D * {t} * exp({poly} - ({z}) * ({z}) / 2))"
    return f"if(({z}) < 0, {tail}, 1.0D - {tail})"


def _text_bits(part: str) -> str:
    """SQL: -log2 of the likelihood of ``part`` under the text model, the likelier of both cases."""
    rates = [(1 - LETTER_FLOOR) * r / sum(LETTER_RATES) + LETTER_FLOOR / 26 for r in LETTER_RATES]
    symbol = ", ".join(f"{-math.log2(r)!r}D" for r in rates + [0.1] * 10 + [0.25] * len(MARKS))
    classes = "l" * 26 + "u" * 26 + "d" * 10 + "m" * len(MARKS)
    chain = ", ".join(f"{-math.log2(r / 100)!r}D" for row in CLASS_RATES for r in row)

    def steps(order: str) -> str:
        return (f"aggregate(split(translate({part}, '{LOWER + UPPER + DIGITS + MARKS}', '{classes}'), ''), "
                f"named_struct('last', 0, 't', 0.0D), (t, c) -> named_struct('last', instr('{order}', c), "
                f"'t', t.t + element_at(array({chain}), t.last * 4 + instr('{order}', c))), t -> t.t)")

    symbols = (f"aggregate(split(lower({part}), ''), 0.0D, "
               f"(t, c) -> t + element_at(array({symbol}), instr('{LOWER + DIGITS + MARKS}', c)))")
    return f"({symbols} + least({steps('ludm')}, {steps('uldm')}))"


def _scored(spans: str) -> str:
    """SQL: the spans of array ``spans`` with encoding, n (length) and p (see the module's text).

    Each ``transform`` names the values that the next one uses.
    """
    inside = " ".join(f"when translate(s.part, '{a}', '') = '' then named_struct('name', '{name}', 'letters', '{a}', "
                      f"'effect', {effect}D)" for name, a, effect in ENCODINGS)
    x = (f"transform({spans}, s -> named_struct('s', s, 'n', length(s.part), 'a', case {inside} end))")
    x = f"""transform({x}, r -> named_struct('s', r.s, 'n', r.n, 'a', r.a, 'k', length(r.a.letters),
        'x', transform(split(r.s.part, ''), c -> instr(r.a.letters, c)),
        'c', aggregate(split(r.a.letters, ''), 0.0D, (t, c) -> t + power(r.n - length(replace(r.s.part, c, '')), 2))))"""
    x = f"""transform({x}, r -> named_struct('s', r.s, 'n', r.n, 'a', r.a, 'k', r.k, 'c', r.c, 'x', r.x,
        'up', transform(r.x, v -> if(v * 2 > r.k, 1, 0)),
        'mean', aggregate(r.x, 0.0D, (t, v) -> t + v) / r.n))"""
    x = f"""transform({x}, r -> named_struct('s', r.s, 'n', r.n, 'a', r.a, 'k', r.k,
        'chi', r.c * r.k / r.n - r.n, 'n1', aggregate(r.up, 0.0D, (t, v) -> t + v),
        'runs', aggregate(r.up, named_struct('last', -1, 'r', 0.0D),
            (t, v) -> named_struct('last', v, 'r', t.r + if(v = t.last, 0, 1)), t -> t.r),
        'var', aggregate(r.x, 0.0D, (t, v) -> t + power(v - r.mean, 2)),
        'cov', aggregate(r.x, named_struct('last', cast(null as double), 'c', 0.0D),
            (t, v) -> named_struct('last', v - r.mean, 'c', t.c + coalesce(t.last * (v - r.mean), 0.0D)), t -> t.c)))"""
    x = f"""transform({x}, r -> named_struct('r', r, 'mu', 2 * r.n1 * (r.n - r.n1) / r.n + 1))"""
    x = f"""transform({x}, q -> named_struct('q', q,
        'uniform', (q.r.chi - (q.r.k - 1 + q.r.n * q.r.a.effect)) / sqrt(2 * (q.r.k - 1 + 2 * q.r.n * q.r.a.effect)),
        'runs', if(q.mu <= 2, null, (abs(q.r.runs - q.mu) - {DEPENDENCE}D * (q.mu - 1)) / sqrt((q.mu - 1) * (q.mu - 2) / (q.r.n - 1))),
        'serial', if(q.r.var = 0, null, (abs(q.r.cov / q.r.var) - {DEPENDENCE}D) * sqrt(cast(q.r.n as double)))))"""
    x = f"""transform({x}, z -> named_struct('q', z.q, 'battery',
        greatest({normal_cdf('z.uniform')}, coalesce({normal_cdf('z.runs')}, 1.0D), coalesce({normal_cdf('z.serial')}, 1.0D)),
        'structured', z.q.mu <= 2 or z.q.r.var = 0 or coalesce(
            abs(z.q.r.chi - (z.q.r.k - 1)) > {FAR}D * sqrt(2 * (z.q.r.k - 1) * (z.q.r.n - 1) / z.q.r.n)
            or abs(z.q.r.runs - z.q.mu) > {FAR}D * sqrt((z.q.mu - 1) * (z.q.mu - 2) / (z.q.r.n - 1))
            or abs(z.q.r.cov / z.q.r.var) * sqrt(cast(z.q.r.n as double)) > {FAR}D, true),
        'text', if(z.q.r.a.name = 'decimal', 1.0D, {len(ENCODINGS)}D * power(2.0D, z.q.r.n * log2(cast(z.q.r.k as double)) - {_text_bits('z.q.r.s.part')}))))"""
    return f"""transform({x}, w -> named_struct('start', w.q.r.s.start, 'end', w.q.r.s.end, 'kind', w.q.r.s.kind,
        'part', w.q.r.s.part, 'encoding', w.q.r.a.name, 'n', w.q.r.n,
        'p', if(w.structured, w.battery, least(1.0D, 2 * w.battery, 2 * w.text))))"""


def discovery_threshold(runs: DataFrame, fdr: float = FDR) -> tuple[float, float]:
    """(threshold on p / weight, mean length) of the Benjamini-Hochberg step over rows ``n``, ``p``.

    The weight of a run is its length over the mean length, so the weights
    average to 1. p-values are rounded up to bins, so the step errs on the safe
    side. At most ``BINS`` + 1 rows come to the driver.
    """
    total = runs.agg(F.count("*").alias("m"), F.avg("n").alias("mean")).first()
    if not total["m"]:
        return 0.0, 1.0
    weighted = F.col("p") * F.lit(float(total["mean"])) / F.col("n")
    at = F.floor(-F.log2(F.greatest(weighted, F.lit(1e-300))) * BINS_PER_OCTAVE)
    counts = {r["bin"]: r["c"] for r in runs.groupBy(
        F.greatest(F.lit(0), F.least(F.lit(BINS), at)).alias("bin")).agg(F.count("*").alias("c")).collect()}
    found, best = 0, 0.0
    for b in range(BINS, -1, -1):   # from the smallest p-values on
        found += counts.get(b, 0)
        top = 2.0 ** (-b / BINS_PER_OCTAVE)
        if found and total["m"] * top <= fdr * found:
            best = top
    return best, float(total["mean"])


def find_secrets(docs: DataFrame, text_col: str = "text", fdr: float = FDR, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all if not given) with ``base_spans`` and ``added_spans``: arrays of start, end,
    kind (index in ``KINDS``) and part, by start, then kind. Texts are scanned once."""
    kept = [c for c in columns or docs.columns if c not in ("base_spans", "added_spans")]
    scanned = materialise(
        docs.withColumn("__scan", F.expr(_scan(f"`{text_col}`")))
        .select(*kept, F.col("__scan.base").alias("base_spans"), F.expr(_scored("__scan.runs")).alias("__runs")), "scanned")
    threshold, mean = discovery_threshold(scanned.select(F.explode("__runs").alias("r")).select("r.n", "r.p"), fdr)
    return scanned.select(
        *kept, "base_spans",
        F.expr(f"transform(filter(__runs, r -> r.p * {mean!r}D / r.n <= {threshold!r}D), "
               "r -> named_struct('start', r.start, 'end', r.end, 'kind', r.kind, 'part', r.part))").alias("added_spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``MASK`` (overlapping spans by one);
    ``chars_col``, if there, follows the new text. Other rows and null texts stay as they are."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])   # no name clashes with the added columns
    text, chars = (f"c{names.index(c)}" if c in names else None for c in (text_col, chars_col))
    out = (find_secrets(plain, text).withColumn("spans", F.array_sort(F.concat("base_spans", "added_spans")))
           .withColumn("masked", F.expr(_masked(text, "spans"))))
    changed = {text: F.col("masked")}
    if chars:
        changed[chars] = F.when(F.size("spans") > 0, F.length("masked").cast(plain.schema[chars].dataType)).otherwise(F.col(chars))
    return out.withColumns(changed).select(*plain.columns).toDF(*names)


def _masked(text: str, spans: str) -> str:
    """SQL: ``text`` with each group of overlapping ``spans`` (sorted by start) replaced by ``MASK``.

    The text is cut into pieces of ``CUT`` code points first, so that each gap costs its own length.
    """
    def cut(a: str, b: str) -> str:
        first, last = f"cast({a} div {CUT} as int)", f"cast({b} div {CUT} as int)"
        return (f"if({first} = {last}, substring(coalesce(get(pc, {first}), ''), {a} % {CUT} + 1, {b} - {a}), "
                f"concat(substring(get(pc, {first}), {a} % {CUT} + 1), "
                f"array_join(slice(pc, {first} + 2, {last} - {first} - 1), ''), "
                f"substring(coalesce(get(pc, {last}), ''), 1, {b} % {CUT})))")

    fresh = "filter(zip_with(sp, en, (s, e) -> named_struct('start', s.start, 'at', e)), m -> m.start >= m.at)"
    body = (f"concat(array_join(transform({fresh}, m -> concat({cut('m.at', 'm.start')}, '{MASK}')), ''), "
            f"{let('lt', 'named_struct(\'a\', array_max(transform(sp, s -> s.end)), \'z\', length(tx))', cut('lt.a', 'lt.z'))})")
    before = f"concat(array(0), slice({running('transform(sp, s -> s.end)', 'greatest({a}, {b})')}, 1, size(sp) - 1))"
    return (f"if(size({spans}) = 0, {text}, " + let("sp", spans, let("tx", text, let(
        "pc", f"regexp_extract_all(tx, r'(?s).{{1,{CUT}}}', 0)", let("en", before, body)))) + ")")
