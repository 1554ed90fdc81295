"""TXT-1..5: lexicon sentiment of post text as a Spark job.

Plan (no Python, the same one whatever the sizes are):

  docs --split--> sentences --posexplode--> one row per sentence
       --split--> tokens
       --posexplode--> one row per token, with the three before and the two after
       --inner join with the lexicon--> lexicon hits only
       --three look-ups of the preceding words in the lexicon-->
       --group by (doc, sentence), partial then final--> sentence polarity
  union one row per doc with its sentence count, which meets no lexicon
       --group by doc, partial then final--> mean over all sentences

Spark decides how to join from the lexicon's size in bytes: below its broadcast
threshold no token crosses a shuffle, beyond it AQE splits frequent words. The
rows that keep a doc without hits (sentiment 0, or NULL without a sentence) come
from a second read of the text, so they never enter that join. Both groupings
pre-aggregate map side, so a document or a sentence holding a third of all
tokens is summed in its map task.

The rules are those of VADER (Hutto and Gilbert, 2014) in its NLTK 3.8 port; the
lexicon itself is an input table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import col_, round_half_up

# Fixed values (VADER method): compound normalisation, rule weights.
ALPHA = 15.0            # compound = x / sqrt(x^2 + ALPHA)
B_INCR = 0.293          # degree word, intensifying
B_DECR = -0.293         # degree word, dampening
C_INCR = 0.733          # all-caps word in mixed-case text
N_SCALAR = -0.74        # negated word
NEVER_SO_2 = 1.5        # "never so/this" right before the word
NEVER_SO_3 = 1.25       # "never so/this" one further before, or "so/this" with three words before
BUT_BEFORE = 0.5        # words before "but"
BUT_AFTER = 1.5         # words after "but"
EXCL_WEIGHT = 0.292     # per "!", at most EXCL_MAX of them
EXCL_MAX = 4
QM_WEIGHT = 0.18        # per "?" when 2 or 3 of them
QM_MAX_AMP = 0.96       # more than 3 "?"
DISTANCE_SCALE = (1.0, 0.95, 0.9)   # degree word 1, 2, 3 tokens before
COMPOUND_DIGITS = 4     # the library reports compound rounded to 4 places

# Fixed values (VADER method): negation words, in the method's order.
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
)

# Fixed values (VADER method): degree modifiers of one word, then of two (all dampening).
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly",
    "deeply", "effing", "enormously", "entirely", "especially", "exceptionally",
    "extremely", "fabulously", "flipping", "flippin", "fricking", "frickin", "frigging",
    "friggin", "fully", "fucking", "greatly", "hella", "highly", "hugely", "incredibly",
    "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber",
    "unbelievably", "unusually", "utterly", "very",
)
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little",
    "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat",
    "sorta", "sortof", "sort-of",
)
BOOSTER_PAIRS = ("just enough", "kind of", "sort of")

# Fixed values (VADER method): idioms and the valence of a lexicon word in or after one.
IDIOMS = (
    ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5), ("yeah right", -2.0),
    ("cut the mustard", 2.0), ("kiss of death", -1.5), ("hand to mouth", -2.0),
)

# A sentence ends at a newline, or at a run of terminators (closing quotes and
# brackets included) before a blank; a dot inside a URL or a number ends none.
BLANKS_RE = r"[\t\r\f ]+"
END_RE = r"""([.!?]+["')\]]*) """
# A sentence holds at least one character that is neither blank nor terminator.
CONTENT_RE = r"[^.!? ]"
# A sentence holds a token of two or more characters with an upper-case letter and no lower-case one.
UPPER_TOKEN_RE = r"(?<![^ ])(?=[^ ]{2})[^ \p{Ll}\p{Lu}]*+\p{Lu}[^ \p{Ll}]*+(?![^ ])"
# ASCII punctuation, stripped from both ends of a token unless that leaves less
# than two characters (emoticons).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

TASKS_A_CORE = 4

# The neighbours of a token that the rules read, and how far from it they stand.
NEAR = {"p1": -1, "p2": -2, "p3": -3, "n1": 1, "n2": 2}


@dataclass(frozen=True)
class Rules:
    """Which VADER modifiers apply (all on = the library's behaviour)."""

    negation: bool = True
    degree: bool = True
    caps: bool = True
    but: bool = True
    punctuation: bool = True
    idioms: bool = True


BASE = Rules(False, False, False, False, False, False)
FULL = Rules()


def post_text(title, body) -> Column:
    """TXT-1 input: title, newline, body (NULL when either is missing)."""
    return F.concat(col_(title), F.lit("\n"), col_(body))


def sentence_array(text) -> Column:
    """All sentences of a text, trimmed, in order (empty array for NULL text)."""
    squeezed = F.regexp_replace(col_(text), BLANKS_RE, " ")
    parts = F.split(F.regexp_replace(squeezed, END_RE, "$1\n"), "\n")
    return F.coalesce(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s.rlike(CONTENT_RE)),
                      F.array().cast("array<string>"))


def _raw_tokens(sentence) -> Column:
    """Blank-separated tokens of two or more characters, as written."""
    return F.filter(F.split(col_(sentence), " "), lambda t: F.char_length(t) > 1)


def _strip(t: Column) -> Column:
    """A token without outer punctuation."""
    bare = F.btrim(t, F.lit(PUNCTUATION))
    return F.when(F.char_length(bare) > 1, bare).otherwise(t)


def token_array(sentence) -> Column:
    """Blank-separated tokens of two or more characters, without outer punctuation."""
    return F.transform(_raw_tokens(sentence), _strip)


def even_tasks(df: DataFrame) -> int:
    """How many tasks text is dealt over: several for each core, so that a slow one holds no core up for long.

    A number given to ``repartition`` stays as it is; Spark merges others by bytes until a wave and a bit are left,
    and each token costs far more than its bytes.
    """
    return TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism


def _source(df: DataFrame, id_col: str, text, carry: list[str], spread: int | None) -> DataFrame:
    src = df.select(F.col(id_col).alias("id"), col_(text).alias("_text"), *carry)
    return src.repartition(spread, "id") if spread else src


def sentences(df: DataFrame, id_col: str, text, spread: int | None = None) -> DataFrame:
    """TXT-1: (id, sent_idx, sentence), sent_idx from 0. ``spread`` deals the
    documents over so many tasks first (for input in few, unsplittable files)."""
    return _source(df, id_col, text, [], spread).select(
        "id", F.posexplode(sentence_array("_text")).alias("sent_idx", "sentence"))


def _count_char(s: Column, ch: str) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(ch), F.lit("")))


def _punct_amp(s: Column) -> Column:
    ex = F.least(_count_char(s, "!"), F.lit(EXCL_MAX)) * F.lit(EXCL_WEIGHT)
    q = _count_char(s, "?")
    qm = F.when(q > 3, F.lit(QM_MAX_AMP)).when(q > 1, q * F.lit(QM_WEIGHT)).otherwise(F.lit(0.0))
    return ex + qm


def _sql_str(w: str) -> str:
    return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in_words(expr_sql: str, words) -> Column:
    """``<expr> IN (<words>)`` parsed once on the JVM: one call for the whole list."""
    return F.expr(f"{expr_sql} IN ({', '.join(_sql_str(w) for w in words)})")


def _is_upper(t: Column) -> Column:
    """Has an upper-case letter and no lower-case one (Python's ``isupper``)."""
    return t.rlike(r"^[^\p{Ll}\p{Lu}]*+\p{Lu}[^\p{Ll}]*+$")


def _modifiers(hits: DataFrame, rules: Rules) -> DataFrame:
    """What each preceding word does, as columns that the rules then read: ``_b1..3``
    (degree), ``_u1..3`` (in capitals), ``_neg1..3``."""
    out = hits.withColumns({f"l{k}": F.lower(f"p{k}") for k in (1, 2, 3)})
    cols = {}
    for k in (1, 2, 3):
        # a preceding word that is itself in the lexicon modifies nothing
        plain = F.col(f"l{k}").isNotNull() & ~F.col(f"_lex{k}")
        cols[f"_plain{k}"] = plain
        if rules.degree:
            cols[f"_b{k}"] = F.when(plain & _in_words(f"l{k}", BOOSTERS_UP), F.lit(B_INCR)).when(
                plain & _in_words(f"l{k}", BOOSTERS_DOWN), F.lit(B_DECR))
        if rules.negation:
            cols[f"_neg{k}"] = plain & (_in_words(f"l{k}", NEGATIONS) | F.col(f"l{k}").contains("n't"))
    out = out.withColumns(cols)
    if rules.degree and rules.caps:
        out = out.withColumns({f"_u{k}": F.when(F.col(f"_b{k}").isNotNull() & F.col("_capdiff"),
                                                _is_upper(F.col(f"p{k}"))).otherwise(False) for k in (1, 2, 3)})
    return out


def _token_rows(sents: DataFrame) -> DataFrame:
    """One row per token: ``w`` (lower case), ``tok``, ``pos``, its neighbours as written
    (``_near``, in the order of ``NEAR``), and the features of its sentence. A sentence
    without a token has one row with an empty ``w``.

    No lambda runs for a token beyond the length filter: neighbours are taken by position, and
    below a broadcast join only those of lexicon words are. The features of the few sentences that hold
    an upper-case token or "but" are the only ones that look at each token.
    """
    s, toks = F.col("sentence"), F.col("_toks")
    cut = sents.select("id", "sent_idx", s, _punct_amp(s).alias("_amp"), _raw_tokens(s).alias("_toks"))
    but = F.array_position(F.transform(toks, lambda t: F.lower(_strip(t))), "but") - 1
    mixed = F.exists(toks, lambda t: ~_is_upper(t))
    feats = cut.select("id", "sent_idx", "_amp", "_toks",
                       F.when(F.lower(s).contains("but"), but).otherwise(-1).cast("int").alias("_but"),
                       F.when(s.rlike(UPPER_TOKEN_RE), mixed).otherwise(False).alias("_capdiff"))
    # outer, so that Spark does not cut each sentence once more to drop those without tokens
    at = feats.select("id", "sent_idx", "_amp", "_but", "_capdiff", "_toks",
                      F.posexplode_outer("_toks").alias("pos", "_raw"))
    near = F.array(*[F.get(toks, F.col("pos") + d) for d in NEAR.values()])
    bare = at.withColumns({"_bare": F.btrim("_raw", F.lit(PUNCTUATION)), "_near": near})
    tok = bare.withColumn("tok", F.when(F.char_length("_bare") > 1, F.col("_bare")).otherwise(F.col("_raw")))
    return tok.select(F.coalesce(F.lower("tok"), F.lit("")).alias("w"), "id", "sent_idx", "_amp", "_but", "_capdiff",
                      "tok", "pos", "_near")


def _with_neighbours(hits: DataFrame) -> DataFrame:
    """``_near`` as columns ``p1..p3, n1, n2`` without outer punctuation.

    The lambda also ends a generated method: one from the split to the sums would pass the 8,000 bytes up to
    which the JVM compiles a method, and run interpreted.
    """
    bare = hits.withColumn("_near", F.transform("_near", _strip))
    return bare.withColumns({c: F.get("_near", F.lit(i)) for i, c in enumerate(NEAR)}).drop("_near")


def _idiom(*phrases: tuple[str, ...]) -> Column:
    """The valence of the first of the phrases (column names) that is an idiom, else NULL."""
    known = F.create_map(*[F.lit(x) for pair in IDIOMS for x in pair])
    return F.coalesce(*[F.try_element_at(known, F.concat_ws(" ", *names)) for names in phrases])


def _valence(rules: Rules) -> list[Column]:
    """Successive expressions for ``v``, each reading the one before; kept as
    separate projections so no step's expression is copied into the next."""
    v, steps = F.col("v"), []
    if rules.caps:
        steps.append(F.when(F.col("_capdiff") & _is_upper(F.col("tok")),
                            F.when(v > 0, v + F.lit(C_INCR)).otherwise(v - F.lit(C_INCR))).otherwise(v))
    so = {k: F.coalesce(F.col(f"p{k}").isin("so", "this"), F.lit(False)) for k in (1, 2)}
    for k, scale in zip((1, 2, 3), DISTANCE_SCALE):
        plain = F.col(f"_plain{k}") if rules.negation or rules.degree or rules.idioms else None
        if rules.degree:
            b = F.when(v < 0, -F.col(f"_b{k}")).otherwise(F.col(f"_b{k}"))
            if rules.caps:
                b = b + F.when(F.col(f"_u{k}"), F.when(v > 0, F.lit(C_INCR)).otherwise(F.lit(-C_INCR))).otherwise(
                    F.lit(0.0))
            steps.append(v + F.coalesce(b, F.lit(0.0)) * F.lit(scale))
        if rules.negation:
            negated = F.when(F.col(f"_neg{k}"), v * F.lit(N_SCALAR)).otherwise(v)
            if k == 2:
                negated = F.when((F.col("p2") == "never") & so[1], v * F.lit(NEVER_SO_2)).otherwise(negated)
            if k == 3:
                negated = F.when(((F.col("p3") == "never") & so[2]) | so[1],
                                 v * F.lit(NEVER_SO_3)).otherwise(negated)
            steps.append(F.when(plain, negated).otherwise(v))
        if rules.idioms and k == 3:
            around = _idiom(("p1", "tok"), ("p2", "p1", "tok"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))
            from_here = _idiom(("tok", "n1", "n2"), ("tok", "n1"))
            steps.append(F.when(plain, F.coalesce(from_here, around, v)).otherwise(v))
        if rules.degree and k == 3:
            pair = (F.concat_ws(" ", "p3", "p2").isin(*BOOSTER_PAIRS)
                    | F.concat_ws(" ", "p2", "p1").isin(*BOOSTER_PAIRS))
            steps.append(F.when(plain & pair, v + F.lit(B_DECR)).otherwise(v))
    if rules.negation:
        # "least" before a word negates it, except in "at least" / "very least"
        least = ((F.col("l1") == "least") & ~F.col("_lex1")
                 & (F.col("l2").isNull() | ~F.col("l2").isin("at", "very")))
        steps.append(F.when(least, v * F.lit(N_SCALAR)).otherwise(v))
    if rules.degree:
        # a degree word only modifies its neighbours; it scores 0 itself
        own = _in_words("w", BOOSTERS_UP + BOOSTERS_DOWN) | ((F.col("w") == "kind") & (F.lower("n1") == "of"))
        steps.append(F.when(own, F.lit(0.0)).otherwise(v))
    if rules.but:
        b = F.col("_but")
        steps.append(F.when(b < 0, v).when(F.col("pos") < b, v * F.lit(BUT_BEFORE))
                     .when(F.col("pos") > b, v * F.lit(BUT_AFTER)).otherwise(v))
    return steps


def _sentence_scores(sents: DataFrame, lexicon: DataFrame, rules: Rules) -> DataFrame:
    """(id, sent_idx, polarity) of the sentences with a lexicon word: exact sum of
    token values, punctuation, compound."""
    # a repeated word counts once, with its strongest valence (the positive one of two equal)
    lex = (lexicon.filter((F.col("word") != "") & F.col("valence").isNotNull()).groupBy("word")
           .agg(F.max(F.struct(F.abs("valence").alias("a"), "valence")).alias("s"))
           .select(F.col("word").alias("w"), F.col("s.valence").alias("v")))
    hits = _with_neighbours(_token_rows(sents).join(lex, "w"))
    if rules.negation or rules.degree or rules.idioms:
        for k in (1, 2, 3):
            seen = lex.select(F.col("w").alias(f"_w{k}"), F.col("v").alias(f"_v{k}"))
            hits = (hits.join(seen, F.lower(f"p{k}") == F.col(f"_w{k}"), "left")
                    .withColumn(f"_lex{k}", F.col(f"_w{k}").isNotNull()).drop(f"_w{k}", f"_v{k}"))
        hits = _modifiers(hits, rules)
    for expr in _valence(rules):
        hits = hits.withColumn("v", expr)
    agg = hits.groupBy("id", "sent_idx").agg(
        F.sum(F.col("v").cast(P.VALENCE_DECIMAL)).cast("double").alias("x"), F.max("_amp").alias("_amp"))
    x = F.col("x")
    if rules.punctuation:
        x = (F.when(x > 0, x + F.col("_amp")).when(x < 0, x - F.col("_amp")).otherwise(x))
    compound = x / F.sqrt(x * x + F.lit(ALPHA))
    return agg.select("id", "sent_idx", round_half_up(compound, COMPOUND_DIGITS).alias("polarity"))


def sentence_polarity(df: DataFrame, id_col: str, text, lexicon: DataFrame,
                      rules: Rules = FULL, spread: int | None = None) -> DataFrame:
    """TXT-2: (id, sent_idx, polarity) for every sentence, neutral ones 0."""
    return score_sentences(sentences(df, id_col, text, spread), lexicon, rules)


def score_sentences(sents: DataFrame, lexicon: DataFrame, rules: Rules = FULL) -> DataFrame:
    """TXT-2 on sentences that are cut already: (id, sent_idx, sentence) -> (id, sent_idx, polarity)."""
    every = sents.select("id", "sent_idx", F.lit(0.0).alias("polarity"))
    return (_sentence_scores(sents, lexicon, rules).unionByName(every).groupBy("id", "sent_idx")
            .agg(F.sum("polarity").alias("polarity")))


def text_sentiment(df: DataFrame, id_col: str, text, lexicon: DataFrame, rules: Rules = FULL,
                   carry: list[str] | tuple = (), spread: int | None = None) -> DataFrame:
    """TXT-3: (id, n_sentences, sentiment[, carry...]) -- mean polarity over all
    sentences, neutral ones counting 0; NULL when the text has no sentence.

    ``carry`` columns of ``df`` ride on the row that holds a document's sentence
    count and come out unchanged, so callers need no join back to the documents.
    """
    carry = list(carry)
    docs = _source(df, id_col, text, carry, spread).select(
        "id", F.lit(0).cast(P.POLARITY_DECIMAL).alias("_p"), F.size(sentence_array("_text")).alias("n_sentences"), *carry)
    scored = _sentence_scores(sentences(df, id_col, text, spread), lexicon, rules)
    # summed first: the grouping below sorts its rows when a string rides on them
    sums = scored.groupBy("id").agg(F.sum(F.col("polarity").cast(P.POLARITY_DECIMAL)).alias("_p"))
    rows = docs.unionByName(sums, allowMissingColumns=True)
    per_doc = rows.groupBy("id").agg(
        F.sum("_p").cast("double").alias("_s"), F.max("n_sentences").alias("n_sentences"),
        *[F.max(c).alias(c) for c in carry])
    return per_doc.select("id", "n_sentences",
                          F.try_divide(F.col("_s"), F.col("n_sentences")).alias("sentiment"), *carry)
