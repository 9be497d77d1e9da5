"""Text cut off by field limits or mid-transfer, and how often each producer does it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segloom.llm.turns import ANNOTATION, HESITATION, STAMP
from segloom.runtime import broadcast_if_small, cut

#: A word is known from so many occurrences that no cut can have shortened, if it is also seen this share as often as the
#: most frequent known word that goes on from it. Slips of the pen grow with the corpus as the words they slip from
#: do, so the rule is the same at every size.
KNOWN_COUNT = 3
KNOWN_SHARE = 0.002
#: Letters up to which the trie is a table of prefixes; longer tokens are compared with the long words that begin alike.
TRIE_DEPTH = 64
#: Share of punctuated ends from which a producer's rows of one type count as punctuated prose.
PUNCTUATED = 0.5
#: A length is a field limit if so many times as many rows have it as the ten lengths below have each.
PILE = 3.0
#: Characters by which a mark put in place of the rest, or a blank before it, may shorten a row at the limit.
SLACK = 3
#: Distinct counters held by a task before they are emitted.
FLUSH = 200_000
#: Distinct final words whose verdicts are broadcast; beyond it that join is shuffled.
BROADCAST_WORDS = 500_000

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ASCII_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)*")
#: Damage that only a transfer leaves: a replacement character, or the start of an escape or entity.
BROKEN = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&(?:a(?:mp?)?|l(?:t)?|g(?:t)?|q(?:u(?:ot?)?)?|n(?:b(?:sp?)?)?|ap?o?s?|#x?[0-9a-fA-F]{0,5})|%[0-9A-F]?)\Z")
TRAILER = re.compile(r"\s*(?:\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|【[^【】]*】|♪[^♪]*♪|(?<!\*)\*[^*\n]+\*)\s*\Z")
AFTER_LABEL = re.compile(r"[:：>\])|*]|\s[-–—]\s")

EVENT = pa.schema(
    [
        ("kind", pa.string()),
        ("producer", pa.string()),
        ("segment_type", pa.string()),
        ("word", pa.string()),
        ("ending", pa.string()),
        ("seg_id", pa.int64()),
        ("chars", pa.int64()),
        ("bytes", pa.int64()),
        ("n", pa.int64()),
    ]
)
EVENT_DDL = "kind string, producer string, segment_type string, word string, ending string, seg_id bigint, chars bigint, bytes bigint, n bigint"


CLOSERS = "\"”’')]»"
TRAILER_ENDS = frozenset("])>}】♪*")
#: No transfer damage but a row of replacement characters is longer.
TAIL = 40


def stops(body: str) -> bool:
    """True for the plain case: one mark that ends a sentence, and not a row of dots."""
    return bool(body) and (body[-1] in "!?。！？" or (body[-1] == "." and body[-3:] != "..."))


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (ASCII_TOKEN if text.isascii() else TOKEN).findall(text)


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def word_before(text: str, end: int) -> str:
    """The word that ends just before ``end``, empty if none does; a word of any length is read whole."""
    at = end
    while at > 0 and (_letter(text[at - 1]) or (text[at - 1] in "'’" and 1 < at < end and _letter(text[at - 2]))):
        at -= 1
    return text[at:end]


def ending(text: str) -> tuple[str, str]:
    """How a text ends, and its final word in lower case (empty if the end holds none).

    closed: sentence punctuation, a quoted title, or nothing spoken after the last label but annotations and
    hesitations; dash: broken off by the speaker; dots: trailing off or a mark for the rest; broken:
    transfer damage; open: anything else. The same end means the same after a text of any length.
    """
    body = text.rstrip()
    if stops(body):
        return "closed", ""
    if m := BROKEN.search(body[-TAIL:]):
        at = max(0, len(body) - TAIL) + m.start()
        while at > 0 and not _letter(body[at - 1]):
            at -= 1
        return "broken", word_before(body, at).lower()
    while body and body[-1] in TRAILER_ENDS and (m := TRAILER.search(body)) and m.start() < len(body):
        body = body[: m.start()].rstrip()
    if not body or stops(body):
        return "closed", ""
    core = body.rstrip(CLOSERS)
    if core.endswith(("...", "…")):
        kind, body = "dots", core[:-1] if core[-1] == "…" else core.rstrip(".")
        body = body[:-1] if body and body[-1].isspace() else body
    elif (core and core[-1] in ".!?。！？") or body[-1] in "\"”»":
        return "closed", ""
    elif core and core[-1] in "—–-":
        return "dash", ""
    else:
        kind = "open"
    last = word_before(body, len(body)).lower()
    # What follows the last label may be bare hesitations or nothing, which is complete as it is.
    if not last or HESITATION.match(last):
        plain = STAMP.sub(" ", ANNOTATION.sub(" ", body)).rstrip()
        tail = AFTER_LABEL.split(plain)[-1]
        begun = plain.endswith("*") and not plain.endswith("**")  # an annotation that was cut as it began
        if not begun and all(HESITATION.match(w.lower()) for w in TOKEN.findall(tail)):
            return "closed", ""
    return kind, last


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass: word counts, length and style counts, and the rows whose end needs a verdict."""
    words: Counter = Counter()
    lengths: Counter = Counter()
    styles: Counter = Counter()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = rows + [("word", None, None, w, None, None, None, None, n) for w, n in words.items()]
        out += [("length", p, None, None, e, None, c, b, n) for (p, c, b, e), n in lengths.items()]
        out += [("style", p, t, None, e, None, None, None, n) for (p, t, e), n in styles.items()]
        words.clear(), lengths.clear(), styles.clear(), rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), EVENT.types, strict=True)], schema=EVENT)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("seg_id", "segment_type", "producer", "content")]
        for seg, kind, producer, text in zip(*columns, strict=True):
            how, last = ending(text)
            tokens = words_of(BROKEN.sub("", text.rstrip()) if how == "broken" else text)
            if last and how != "closed" and tokens:
                tokens.pop()
            words.update(tokens)
            size = len(text)
            octets = size if text.isascii() else len(text.encode())
            lengths[producer, size, octets, how] += 1
            styles[producer, kind, how] += 1
            if how not in ("closed", "dash"):
                rows.append(("row", producer, kind, last, how, seg, size, octets, None))
        if len(words) + len(lengths) + len(rows) > FLUSH:
            yield flush()
    if words or lengths or rows:
        yield flush()


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _limits(lengths: DataFrame) -> DataFrame:
    """Field limits: lengths, in code points or bytes, at which a producer's rows pile up and above which next to none lie.

    Two a producer at most; the windows run over distinct lengths, not rows.
    """
    out = None
    for unit in ("chars", "bytes"):
        counts = lengths.groupBy("producer", unit).agg(F.sum("n").alias("n"))
        w = Window.partitionBy("producer").orderBy(unit)
        under = F.coalesce(F.sum("n").over(w.rangeBetween(-10, -5)), F.lit(0))
        above = F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
        piles = (
            counts.withColumn("under", under)
            .withColumn("above", above)
            .where((F.col("n") >= 5) & (F.col("n") >= PILE * F.col("under") / 6) & (F.col("above") <= 0.05 * F.col("n")))
            .groupBy("producer")
            .agg(F.max(unit).alias("length_limit"))
            .select("producer", F.lit(unit).alias("unit"), "length_limit")
        )
        out = piles if out is None else out.unionByName(piles)
    return out.groupBy(F.col("producer").alias("lp")).agg(
        F.max(F.when(F.col("unit") == "chars", F.col("length_limit"))).alias("char_limit"),
        F.max(F.when(F.col("unit") == "bytes", F.col("length_limit"))).alias("byte_limit"),
    )


def _at_limit():
    near = lambda unit, limit: F.coalesce(F.col(unit).between(F.col(limit) - SLACK, F.col(limit)), F.lit(False))
    return near("chars", "char_limit") | near("bytes", "byte_limit")


def _verdicts(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """What the corpus trie says of each distinct final token: token, own, beyond.

    ``own`` is how often the token is a word of its own, ``beyond`` how often the most frequent known word is that goes on from
    it. The trie is a table of the known words' prefixes; a word of any length is in it.
    """
    known = events.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN_COUNT)
    depth = F.least(F.length("word"), F.lit(TRIE_DEPTH))
    nodes = known.select("word", "n", F.explode(F.sequence(F.lit(1), depth)).alias("k")).select(
        F.expr("substring(word, 1, k)").alias("node"), F.when(F.col("k") == F.length("word"), F.col("n")).alias("own"), F.when(F.col("k") < F.length("word"), F.col("n")).alias("beyond")
    )
    short = tokens.where(F.length("token") <= TRIE_DEPTH)
    deep = tokens.where(F.length("token") > TRIE_DEPTH).withColumn("node", F.substring("token", 1, TRIE_DEPTH))
    long = known.where(F.length("word") > TRIE_DEPTH).withColumn("node", F.substring("word", 1, TRIE_DEPTH))
    same = F.col("word") == F.col("token")
    met = nodes.join(broadcast_if_small(short, BROADCAST_WORDS), F.col("node") == F.col("token")).select("token", "own", "beyond")
    met_deep = (
        deep.join(long, "node")
        .where(F.startswith("word", "token"))
        .select("token", F.when(same, F.col("n")).alias("own"), F.when(~same, F.col("n")).alias("beyond"))
    )
    return met.unionByName(met_deep).groupBy("token").agg(F.max("own").alias("own"), F.max("beyond").alias("beyond"))


def truncated(df: DataFrame) -> DataFrame:
    """Rows whose content lost its end: seg_id, producer, segment_type, reason, verdict.

    Needs seg_id, segment_type, producer, content; other columns are ignored. ``verdict`` is what the corpus trie
    says of the final token: ``cut`` if it is no known word but known words go on from it, ``word`` if it is one, ``new``
    if neither, ``none`` if the end holds no token. ``reason``: ``word``, the token is cut; ``sentence``, it is whole or
    new, but the producer's rows of that type are punctuated prose and this end is not; ``limit``, whole or
    new before dots at the producer's field limit, a pile of rows at its greatest length in code points or
    bytes, where most rows end in dots; ``broken``, damage that only a transfer leaves. The speaker's own
    dots and dashes, hesitations, titles, annotations and unpunctuated styles are complete.

    Null and blank contents are no case; a repeated seg_id gives one row; null producer and type are
    groups like any other; texts and words of any length are read whole; an empty input gives no row.
    """
    rows = df.where(F.col("content").isNotNull() & F.col("content").rlike(r"(?U)\S")).select(
        "seg_id", F.lower(F.trim("segment_type")).alias("segment_type"), "producer", "content"
    )
    events = cut(rows.mapInArrow(_scan, EVENT_DDL))
    # The tables below have a row for each producer, producer and type, or final word; each is made once.
    closed = F.col("ending").isin("closed", "dash", "dots")
    shape = cut(
        events.where("kind = 'style'")
        .groupBy(F.col("producer").alias("sp"), F.col("segment_type").alias("st"))
        .agg((F.sum(F.when(closed, F.col("n")).otherwise(0)) / F.sum("n")).alias("punctuated"))
    )
    lengths = events.where("kind = 'length'").select("producer", "ending", "chars", "bytes", "n")
    limits = _limits(lengths)
    # Dots mark a cut only where the producer's rows at the limit mostly end in them.
    dotted = (
        lengths.where(F.col("ending").isin("open", "dots", "broken"))
        .join(limits, _same("producer", "lp"))
        .where(_at_limit())
        .groupBy(F.col("lp").alias("dp"))
        .agg((F.sum(F.when(F.col("ending") == "dots", F.col("n")).otherwise(0)) / F.sum("n")).alias("dot_share"))
    )
    # A row without a type may be of any of its producer's styles.
    typed = F.when(F.col("st").isNotNull(), F.col("punctuated"))
    producers = shape.groupBy(F.col("sp").alias("pp")).agg(F.min(typed).alias("least"), F.max(typed).alias("most"))
    profile = cut(producers.join(limits, _same("pp", "lp"), "left").join(dotted, _same("pp", "dp"), "left").drop("lp", "dp"))
    found = events.where("kind = 'row'").select("seg_id", "producer", "segment_type", "word", "ending", "chars", "bytes")
    tokens = found.where("word <> ''").select(F.col("word").alias("token")).distinct()
    verdicts = cut(_verdicts(events, tokens))
    joined = (
        found.join(broadcast_if_small(shape, BROADCAST_WORDS), _same("producer", "sp") & _same("segment_type", "st"), "left")
        .join(broadcast_if_small(profile, BROADCAST_WORDS), _same("producer", "pp"), "left")
        .join(broadcast_if_small(verdicts, BROADCAST_WORDS), F.col("word") == F.col("token"), "left")
    )
    own, beyond = (F.coalesce(c, F.lit(0)) for c in ("own", "beyond"))
    verdict = (
        F.when(F.col("word") == "", F.lit("none"))
        .when((own > 0) & (own >= KNOWN_SHARE * beyond), F.lit("word"))
        .when(beyond > 0, F.lit("cut"))
        .otherwise(F.lit("new"))
    )
    is_open, is_dots = F.col("ending") == "open", F.col("ending") == "dots"
    # A sound's name is a title: only a field limit can have cut it.
    cut_word = (F.col("verdict") == "cut") & ((F.coalesce(F.col("segment_type"), F.lit("")) != "sound") | _at_limit())
    untyped = F.col("segment_type").isNull() & F.col("least").isNotNull()
    style = F.when(untyped & _at_limit(), F.col("most")).when(untyped, F.col("least")).otherwise(F.col("punctuated"))
    prose = F.coalesce(style >= PUNCTUATED, F.lit(False))
    reason = (
        F.when(F.col("ending") == "broken", F.lit("broken"))
        .when((is_open | is_dots) & cut_word, F.lit("word"))
        .when(is_open & prose, F.lit("sentence"))
        .when(is_dots & _at_limit() & (F.col("dot_share") >= 0.5), F.lit("limit"))
    )
    first = lambda c: F.first(c).alias(c)
    return (
        joined.withColumn("verdict", verdict)
        .withColumn("reason", reason)
        .where("reason is not null")
        .groupBy("seg_id")
        .agg(first("producer"), first("segment_type"), F.min("reason").alias("reason"), F.min("verdict").alias("verdict"))
    )


def truncation_rates(df: DataFrame) -> DataFrame:
    """Per producer: contents, truncated ones and their share. Repeated deliveries count once, blank contents do not count."""
    bad = truncated(df).groupBy("producer").agg(F.count(F.lit(1)).alias("truncated"))
    once = df.where(F.col("content").rlike(r"(?U)\S")).select("producer", "seg_id").distinct()
    every = once.groupBy(F.col("producer").alias("p")).agg(F.count(F.lit(1)).alias("contents"))
    joined = every.join(bad, F.col("p").eqNullSafe(F.col("producer")), "left")
    n = F.coalesce("truncated", F.lit(0)).cast("bigint")
    return joined.select(F.col("p").alias("producer"), "contents", n.alias("truncated"), (n / F.col("contents")).alias("rate"))
