"""Personal data: pattern spans, and identifiers found by bootstrapped contexts.

Only column functions are used. The base spans are the valid matches of four fixed
patterns. Each of them is a seed of a bootstrap, whatever its length, digits or inner
spaces. Every other token with a digit that has at least six characters and touches
no base span is a possible identifier; this length rule holds for no seed. The
contexts of both (the word before, the two words before, the key before `=` or `:` at
the token's start) are lexical patterns; a span that starts inside a token has the
words before that token. Patterns and distinct values form a graph. In each round a pattern's confidence is the mean confidence of its values,
damped for rare patterns, and the confidence of a value that is no seed is the
highest of its patterns that enough trusted values support. Values that end at or above
the threshold are added as spans of kind `context`; base spans are never changed.

Regular expressions use possessive loops, so they take no stack and no quadratic
time on long runs, and match exactly what the plain forms match.

Defined cases: null and empty texts have no spans; repeated rows each give a row
with the same spans and count once as evidence; a null id is kept; other columns
are not looked at; an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.llm import common

# The kinds in order. Each pattern finds what the form behind it finds.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"  # a token with a digit, from its start
KEY = r"^([^\s0-9=:]++[=:])"  # letters and then = or :
LEAST_LENGTH = 6  # of a token that is no seed
ROUNDS = 3
THRESHOLD = 0.8
SUPPORT = 3  # trusted values that a pattern needs

SPANS = "array<struct<start:int,end:int>>"
ITEM = "struct<start:int,end:int,value:string,one:string,two:string,key:string>"
FOUND = f"array<{ITEM}>"
FOLD_PART = 64
PIECE = 4096  # characters


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # at most 255, whatever zeros stand in front
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(13, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _places(text: Column, pattern: str, keep) -> Column:
    """Matches that `keep` accepts, with their code point positions and contexts: the gaps
    between matches come from a split by the same pattern, positions are running lengths."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    words = F.struct(F.lit("").alias("two"), F.lit("").alias("one"), F.expr("cast(array() as array<string>)").alias("open"))

    def step(state, m):
        start = state["at"] + F.length(m["gaps"])
        end = start + F.length(m["matches"])

        def add(words):
            found = F.struct(start.alias("start"), end.alias("end"), m["matches"].alias("value"), *_contexts(words))
            return F.struct(F.struct(end.alias("at"), _passed(words, m["matches"]).alias("words")).alias("state"), F.when(keep(m["matches"]), found).alias("out"))

        return _let(_passed(state["words"], m["gaps"]), add)

    zipped = F.arrays_zip(matches.alias("matches"), gaps.alias("gaps"))
    pairs = F.slice(zipped, F.lit(1), F.size(matches))
    return _fold(pairs, F.struct(F.lit(0).alias("at"), words.alias("words")), step, ITEM)


def _fold(array: Column, first: Column, step, kind: str, finish=lambda items, state: items) -> Column:
    """A fold that gives out at most one item at a step, in time that grows with the array.
    step(state, x) is a struct of the next state and `out`, null for none. Every step of
    `aggregate` copies its state, so what is given out must not pile up in it: a first
    pass over parts of FOLD_PART elements keeps the state at the start of each part, and
    a second folds each part on its own."""

    def parted(array):
        count = F.ceil(F.size(array) / F.lit(FOLD_PART)).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(_nothing("array<int>"))
        return F.transform(numbers, lambda i: F.slice(array, i * FOLD_PART + 1, F.lit(FOLD_PART)))

    def starts(parts):
        zero = F.struct(first.alias("state"), F.slice(F.array(first), 1, 0).alias("starts"))
        small = lambda part, state: F.aggregate(part, state, lambda s, x: step(s, x)["state"])
        return F.aggregate(parts, zero, lambda acc, part: F.struct(small(part, acc["state"]).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts")))

    def items(part):
        zero = F.struct(part["start"].alias("state"), _nothing(f"array<{kind}>").alias("items"))

        def add(acc, x):
            grown = lambda m: F.when(m["out"].isNull(), acc["items"]).otherwise(F.concat(acc["items"], F.array(m["out"])))
            return _let(step(acc["state"], x), lambda m: F.struct(m["state"].alias("state"), grown(m).alias("items")))

        return F.aggregate(part["part"], zero, add, lambda acc: acc["items"])

    def both(parts):
        return _let(starts(parts), lambda known: finish(F.flatten(F.transform(F.arrays_zip(parts.alias("part"), known["starts"].alias("start")), items)), known["state"]))

    return _let(array, lambda a: _let(parted(a), both))


def _untouched(tokens: Column, spans: Column) -> Column:
    """The tokens that share no place with a span, by one pass over both in order."""
    none = F.lit(None).cast(ITEM)
    seen = lambda a, item: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(item).alias("order"), x["end"].alias("end"), (x if item else none).alias("item")))
    events = F.array_sort(F.concat(seen(spans, 0), seen(tokens, 1)))
    first = F.struct(F.lit(0).alias("reach"), none.alias("open"), F.lit(0).alias("until"))

    def step(state, e):
        token = e["order"] == 1
        # a token is given out when the next one comes, if no span has touched it by then
        hit = ~token & (e["start"] < state["until"])
        opened = F.when(token, F.when(state["reach"] <= e["start"], e["item"])).when(hit, none).otherwise(state["open"])
        reach = F.when(token, state["reach"]).otherwise(F.greatest(state["reach"], e["end"]))
        until = F.when(token, e["end"]).otherwise(state["until"])
        return F.struct(F.struct(reach.alias("reach"), opened.alias("open"), until.alias("until")).alias("state"), F.when(token, state["open"]).alias("out"))

    last = lambda items, state: F.when(state["open"].isNull(), items).otherwise(F.concat(items, F.array(state["open"])))
    return F.when(F.size(spans) == 0, tokens).otherwise(_fold(events, first, step, ITEM, last))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nothing(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _passed(words: Column, piece: Column) -> Column:
    """The two words before the token that a text ends in, and the parts of that token,
    after one more piece of text. Parts are joined only when the token is over."""

    def move(flat):
        last = F.split(F.substring_index(F.concat(words["one"], F.lit(" "), F.array_join(words["open"], ""), flat), " ", -3), " ", -1)
        moved = _let(last, lambda p: F.struct(F.get(p, F.lit(0)).alias("two"), F.get(p, F.lit(1)).alias("one"), F.array(F.get(p, F.lit(2))).alias("open")))
        same = F.struct(words["two"].alias("two"), words["one"].alias("one"), F.concat(words["open"], F.array(flat)).alias("open"))
        return F.when(flat.contains(" "), moved).otherwise(same)

    return _let(F.regexp_replace(piece, r"\s++", " "), move)


def _contexts(words: Column) -> list:
    one, before = F.lower(words["one"]), F.array_join(words["open"], "")
    two = F.when(words["two"] != "", F.concat_ws(" ", F.lower(words["two"]), one)).otherwise("")
    # what stands in the token before the span; a span behind another one has no key
    key = F.when(F.size(F.filter(words["open"], lambda p: p != "")) == 1, F.regexp_extract(F.lower(before), KEY + "$", 1)).otherwise("")
    return [one.alias("one"), two.alias("two"), key.alias("key")]


def _found(df, columns, text_col, rounds, threshold, support):
    """`columns` of every row, an array of spans per kind, and `context`."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    needs = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    rows = df.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_own_{c}") for c in columns))
    own = [f"_own_{c}" for c in columns]
    spans = [F.when(needs[k], _places(text, PATTERNS[k], _valid_for(k))).otherwise(_nothing(FOUND)).alias(k) for k in KINDS]
    tokens = F.when(text.rlike("[0-9]"), _places(text, TOKEN, lambda m: F.length(m) >= LEAST_LENGTH)).otherwise(_nothing(FOUND))
    base = rows.select(*own, *spans, tokens.alias("_tokens")).withColumn("_row", F.monotonically_increasing_id())
    base = common.staged(base)

    # every base span is a seed; tokens that touch one are no evidence of their own
    free = _untouched(F.col("_tokens"), F.col("_base"))
    evidence = F.concat(
        F.transform("_base", lambda s: F.struct(s.alias("item"), F.lit(True).alias("seed"))),
        F.transform(free, lambda t: F.struct(F.struct(t["start"], t["end"], t["value"], t["one"], t["two"], F.regexp_extract(F.lower(t["value"]), KEY, 1).alias("key")).alias("item"), F.lit(False).alias("seed"))))
    marked = base.select("_row", "_tokens", F.concat(*KINDS).alias("_base")).filter((F.size("_tokens") > 0) | (F.size("_base") > 0))
    marked = marked.select("_row", F.explode(evidence).alias("e")).select("_row", "e.item.*", "e.seed")
    patterns = F.filter(F.array(
        F.when(F.col("one") != "", F.concat(F.lit("1 "), "one")), F.when(F.col("two") != "", F.concat(F.lit("2 "), "two")), F.when(F.col("key") != "", F.concat(F.lit("k "), "key"))), lambda p: p.isNotNull())
    # a value's copies count once; values that are a seed anywhere stay seeds
    edges = common.staged(marked.select(F.explode(patterns).alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    trusted = _scores(edges, rounds, threshold, support)
    new = marked.filter("not seed").join(trusted, "value", "left_semi").select("_row", F.struct("start", "end").alias("span"))
    added = new.groupBy("_row").agg(F.array_sort(F.collect_list("span")).alias("context"))
    out = base.drop("_tokens").join(added, "_row", "left").withColumn("context", F.coalesce("context", _nothing(SPANS)))
    places = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(f"_found_{k}") for k in [*KINDS, "context"]]
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, columns)), *places)


def find(df: DataFrame, id_col="doc_id", text_col="text", rounds=ROUNDS, threshold=THRESHOLD, support=SUPPORT) -> DataFrame:
    """One row per row of `df`: id, n_email, n_ip, n_card, n_phone, base_sha256, spans
    (kind:start:end, by kind, then start), and n_context."""
    out = _found(df, [id_col], text_col, rounds, threshold, support)
    text_of = {k: _spelt(k) for k in [*KINDS, "context"]}
    return out.select(
        id_col, *(F.size(f"_found_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*(text_of[k] for k in KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*text_of.values()), ",").alias("spans"), F.size("_found_context").cast("long").alias("n_context"))


def redact(df: DataFrame, text_col="text", rounds=ROUNDS, threshold=THRESHOLD, support=SUPPORT) -> DataFrame:
    """`df` with every span replaced by its kind in brackets; of overlapping spans the
    first gives its kind and all are removed. Null texts stay null."""
    out = _found(df, df.columns, text_col, rounds, threshold, support)
    named = F.concat(*(F.transform(f"_found_{k}", _named(k)) for k in [*KINDS, "context"]))
    text = F.col(f"`{text_col}`")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces, start, end):
        """Characters from start to end, out of the few pieces that hold them."""
        lo = F.floor(start / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, lo + 1, F.floor(end / PIECE).cast("int") - lo + 1), "")
        return F.when(end > start, F.substring(some, start - lo * PIECE + 1, end - start)).otherwise("")

    def clean(pieces):
        def step(state, s):
            part = F.concat(cut(pieces, state["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.struct(F.greatest(state["at"], s["end"]).alias("at")).alias("state"), F.when(s["start"] >= state["at"], part).alias("out"))

        tail = lambda parts, state: F.concat(F.array_join(parts, ""), cut(pieces, state["at"], F.length(text)))
        return _fold(F.array_sort("_found_spans"), F.struct(F.lit(0).alias("at")), step, "string", tail)

    rest = _let(pieces, clean)
    changed = F.when(F.size("_found_spans") == 0, text).otherwise(rest)
    out = out.withColumn("_found_spans", named)
    return out.select(*(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))


def _named(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _valid_for(kind: str):
    return lambda m: _valid(kind, m)


def _spelt(kind: str) -> Column:
    return F.transform(f"_found_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _scores(edges: DataFrame, rounds: int, threshold: float, support: int) -> DataFrame:
    """Values that are no seed and end with at least the threshold's confidence."""
    seeds = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    values = seeds.select("value", "seed", F.col("seed").cast("double").alias("trust"))
    for _ in range(rounds):
        rated = edges.select("pattern", "value").join(values, "value").groupBy("pattern").agg(
            (F.sum("trust") / (F.count("*") + 1)).alias("confidence"), F.sum((F.col("trust") >= threshold).cast("int")).alias("trusted"))
        strong = rated.filter(F.col("trusted") >= support).select("pattern", "confidence")
        reached = edges.filter("not seed").select("pattern", "value").join(strong, "pattern").groupBy("value").agg(F.max("confidence").alias("confidence"))
        values = seeds.join(reached, "value", "left").select("value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("trust"))
        values = common.staged(values)
    return values.filter(~F.col("seed") & (F.col("trust") >= threshold)).select("value")
