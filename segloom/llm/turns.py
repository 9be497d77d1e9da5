"""Speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segloom.operators.intervals import gaps
from segloom.operators.ordered import RANGE, slices
from segloom.runtime import broadcast_if_small, cut

ENTITY = ["job_id"]
ORDER = ["start_ms", "chunk_index", "ord", "seg_id"]
#: Largest roster that is shipped to the tasks, in people; the table is declared as fixed at a few hundred.
ROSTER_ROWS = 200_000
#: Most interview jobs whose ids are broadcast; beyond it the join is shuffled.
BROADCAST_JOBS = 500_000
#: Fewest words of a suffix-prefix overlap that is taken for a rolling caption.
OVERLAP_WORDS = 2

STAMP = re.compile(r"[\[(<【]?\s*(?<![\w:])\d{1,3}(?::\d{2}){1,2}(?:[.,]\d{1,3})?(?![\w:])\s*[\])>】]?(?:\s*\|)?")
ANNOTATION = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|【[^【】]*】|（[^（）]*）|♪[^♪]*♪|♪|(?<!\*)\*(?!\*)[^*\n]+\*(?!\*)")
UNCLOSED = re.compile(r"[\[(<{【][^\[\](){}<>【】.?!]*$")
HESITATION = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h+m+|mm+)\Z")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
TITLES = {"dr", "mr", "mrs", "ms", "prof", "professor"}


@functools.lru_cache(maxsize=64)
def label_pattern(longest: int) -> re.Pattern:
    """Where a label may stand and how it may be marked; a bare name has at most ``longest`` characters.

    It may stand where a text, a line or a sentence begins, or after an annotation or another mark. What follows a
    bare name in round brackets may be of any length.
    """
    bare = rf"[^\W\d_][^:：\n\[\]<>?!]{{0,{longest - 1}}}?(?:\s*\([^()\n]*\))?"
    return re.compile(
        rf"""(?P<lead>(?:^|(?<=[\n.?!…—–\-\])}}>】♪*|"”]))\s*(?:(?:>>+|[-–—•])\s*)*)
        (?:<v\s+(?P<voice>[^<>\n]+)>
          |\[(?P<square>[^\[\]\n]+)\]\s*[:：]?
          |\((?P<round>[^()\n]+)\)\s*[:：]?
          |\*\*(?P<bold>[^*\n]+?)\s*[:：]?\s*\*\*\s*[:：]?
          |(?P<dash>{bare})\s+[-–—]\s
          |(?P<colon>{bare})\s*[:：]
        )""",
        re.X | re.M,
    )


OFF = re.compile(r"\s*\([^()]*\)\s*$")
AUTOMATIC = re.compile(r"(?:speaker|spk|spkr|sprecher|s)\s*0*(\d+)\Z")


def fold(text: str) -> str:
    """Lower case without accents; everything but letters and digits parts words."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", plain.lower()))


def one_slip(a: str, b: str) -> bool:
    """True if one letter is inserted, deleted or replaced, or two neighbours are swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    x, y = a[p:], b[p:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


class Roster:
    """The people of one series and every way a label may name them."""

    def __init__(self, people: list[tuple[int, str | None, str | None, int | None]]):
        exact: dict[str, set[int]] = {}
        long: dict[str, set[int]] = {}
        self.seats: dict[int, set[int]] = {}
        for who, name, role, seat in people:
            words = fold(name or "").split()
            forms: list[str] = []
            if words:
                first, last = words[0], words[-1]
                forms = [first, last, f"{first} {last}", f"{last} {first}"]
                for form in (*forms, f"{first[0]} {last}", f"{first} {last[0]}"):
                    long.setdefault(form, set()).add(who)
                forms += [f"{first[0]} {last}", f"{first} {last[0]}", f"{first[0]} {last[0]}", first[0] + last[0]]
            if role:
                forms.append(fold(role))
                long.setdefault(fold(role), set()).add(who)
            for form in forms:
                exact.setdefault(form, set()).add(who)
            if seat is not None:
                self.seats.setdefault(seat, set()).add(who)
        self.exact = exact
        # No form is longer: a label with more words, or twice as many characters and a title, names nobody.
        self.most_words = max([2, *(f.count(" ") + 1 for f in exact)]) + 1
        self.labels = label_pattern(2 * max([10, *map(len, exact)]) + 16)
        self.long = [(form, who) for form, who in long.items() if len(form) >= 4]
        self.cache: dict[str, int | None] = {}

    def who(self, label: str) -> int | None:
        """The person a label names, or None if it names nobody or more than one."""
        if label not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[label] = self._find(label)
        return self.cache[label]

    def _find(self, label: str) -> int | None:
        name = fold(OFF.sub("", label))
        words = name.split()
        if len(words) > 1 and words[0] in TITLES:
            words = words[1:]
            name = " ".join(words)
        if not words or len(words) > self.most_words:
            return None
        found = self.exact.get(name)
        if found is None and (m := AUTOMATIC.match(name)):
            found = self.seats.get(int(m[1]))
        if found is None:
            found = set()
            for form, who in self.long:
                if one_slip(name, form):
                    found |= who
        return next(iter(found)) if found and len(found) == 1 else None


def clean_words(text: str) -> list[str]:
    """Spoken words of a text: no stamps, annotations or hesitation sounds."""
    text = UNCLOSED.sub(" ", ANNOTATION.sub(" ", STAMP.sub(" ", text)))
    return [w for w in WORD.findall(text) if not HESITATION.match(w.lower())]


_SOUND_PUNCT = re.compile(r"\s*\b(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h+m+|mm+)\b(?:\s*(?:\.\.\.|…|,))?", re.I)


def clean_text(text: str) -> str:
    """A part's text without stamps, annotations, hesitation sounds and doubled blanks."""
    text = UNCLOSED.sub(" ", ANNOTATION.sub(" ", STAMP.sub(" ", text)))
    text = _SOUND_PUNCT.sub(" ", text)
    return re.sub(r"\s+([,.;:?!…])", r"\1", " ".join(text.replace("**", " ").split())).strip(" ,-|>")


def parts(text: str, roster: Roster | None) -> list[tuple[int | None, str]]:
    """A row's spoken parts in order: the labelled person, None where no label stands, and the raw text.

    Parts without a spoken word are left out, so that their labels change nothing.
    """
    text = STAMP.sub(" ", text).strip()
    out: list[tuple[int | None, str]] = []
    speaker: int | None = None
    begin = at = 0
    while roster is not None:
        m = roster.labels.search(text, at)
        if m is None:
            break
        label = m[m.lastgroup]
        who = roster.who(label)
        if who is None:
            # The same place may still hold a shorter label, a later one may begin inside this match.
            at = max(m.end("lead"), at) + 1
            continue
        out.append((speaker, text[begin : m.start()]))
        speaker, begin = who, m.end()
        at = begin
        if at < len(text) and not text[at - 1].isspace():
            text = text[:at] + " " + text[at:]
    out.append((speaker, text[begin:]))
    return [(who, words) for who, words in out if clean_words(words)]


def overlap(before: list[str], after: list[str]) -> int:
    """Length of the longest suffix of ``before`` that is a prefix of ``after`` (failure function, linear)."""
    n = min(len(before), len(after))
    joined = after[:n] + [""] + before[len(before) - n :]
    fail = [0] * len(joined)
    for i in range(1, len(joined)):
        k = fail[i - 1]
        while k and joined[i] != joined[k]:
            k = fail[k - 1]
        fail[i] = k + (joined[i] == joined[k])
    return fail[-1] if joined else 0


def bare_words(text: str) -> list[str]:
    """Words of a text as captions repeat them, whatever their case and punctuation."""
    return [w.lower().strip(".,;:?!…\"") for w in text.split()]


def without_overlap(before: list[str], after: str, least: int = OVERLAP_WORDS) -> str:
    """``after`` without the words a rolling caption repeats from the end of the caption before, given as it was shown."""
    n = overlap(before, bare_words(after))
    return " ".join(after.split()[n:]) if n >= least else after


TURN = pa.schema(
    [
        ("job_id", pa.string()),
        ("slice", pa.int32()),
        ("part", pa.int32()),
        ("speaker_id", pa.int32()),
        ("first_seg_id", pa.int64()),
        ("last_seg_id", pa.int64()),
        ("start_ms", pa.int64()),
        ("end_ms", pa.int64()),
        ("text", pa.string()),
        ("head", pa.string()),
        ("tail", pa.string()),
        ("open_left", pa.bool_()),
        ("open_right", pa.bool_()),
    ]
)
TURN_DDL = (
    "job_id string, slice int, part int, speaker_id int, first_seg_id bigint, last_seg_id bigint, start_ms bigint, "
    "end_ms bigint, text string, head string, tail string, open_left boolean, open_right boolean"
)


def _scan(people: Broadcast | None, max_pause_ms: int | None, texts: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rosters: dict = {}
        out: list[tuple] = []
        job = at = None
        begun = fresh = False
        number = 0
        seen = None
        # speaker, first, last, start, end, texts, open_left, first caption, latest caption's words
        turn: list | None = None

        def close(right: bool) -> None:
            nonlocal number
            if turn is not None and (turn[0] is not None or turn[6]):
                speaker, first, last, s, e, said, left, head, tail = turn
                text = " ".join(t for t in said if t) if texts else None
                edges = (head if left else None, " ".join(tail) if right and texts else None)
                out.append((job, at, number, speaker, first, last, s, e, text, *edges, left, right))
                number += 1

        for batch in batches:
            names = ["job_id", RANGE, "seg_id", "start_ms", "end_ms", "content", "series_id"]
            columns = [batch.column(c).to_pylist() for c in names]
            columns.append(batch.column("roster").to_pylist() if people is None else [None] * batch.num_rows)
            for j, r, seg, s, e, text, series, listed in zip(*columns, strict=True):
                if not begun or j != job or r != at:
                    close(begun and at >= 0)
                    turn, job, at, seen = None, j, r, None
                    begun, fresh = True, r >= 0  # nothing of this range has been met
                if seg == seen and seg is not None:
                    continue
                seen = seg
                if series not in rosters:
                    rows = people.value.get(series) if people is not None else [tuple(x.values()) for x in listed or []]
                    rosters[series] = Roster(rows) if rows else None
                for who, words in parts(text, rosters[series]):
                    speaker = who if who is not None else (turn[0] if turn is not None else None)
                    same = turn is not None and speaker == turn[0]
                    if same and max_pause_ms is not None and s - turn[4] > max_pause_ms:
                        same = False
                    said = clean_text(words) if texts else ""
                    if same:
                        turn[2] = seg
                        turn[4] = max(turn[4], e)
                        if said:
                            turn[5].append(without_overlap(turn[8], said))
                            turn[8] = bare_words(said)
                    else:
                        # Words before the range's first label may belong to whoever the label names.
                        unnamed = turn is not None and turn[0] is None and turn[6]
                        close(unnamed)
                        turn = [speaker, seg, seg, s, e, [said], fresh or unnamed, said, bare_words(said)]
                        fresh = False
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TURN.types, strict=True)], schema=TURN)
                out.clear()
        close(begun and at >= 0)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TURN.types, strict=True)], schema=TURN)

    return scan


def _rolled(before: pd.Series, head: pd.Series, text: pd.Series) -> pd.Series:
    """A fragment's text without what its first caption repeats of the fragment before."""
    out = []
    for b, h, t in zip(before, head, text, strict=True):
        n = overlap(b.split(), bare_words(h)) if b and h else 0
        out.append(" ".join(t.split()[n:]) if n >= OVERLAP_WORDS else t)
    return pd.Series(out, dtype=object)


def interview_speech(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Speech rows of interview jobs with their job's series."""
    chosen = (
        jobs.where("profile = 'interview' and id is not null")
        .groupBy(F.col("id").alias("__job"))
        .agg(F.max("series_id").alias("series_id"))
    )
    speech = rows.where((F.col("segment_type") == "speech") & F.col("content").isNotNull()).drop("series_id", "roster")
    return speech.join(broadcast_if_small(chosen, BROADCAST_JOBS), F.col("job_id") == F.col("__job")).drop("__job")


def calibrated_pause(speech: DataFrame, share: float = 0.99) -> int | None:
    """The pause below which ``share`` of all silences between speech rows lie, in milliseconds."""
    silent = gaps(speech, min_gap_ms=1)
    row = silent.agg(F.percentile_approx(F.col("gap_end_ms") - F.col("gap_start_ms"), share).alias("p")).first()
    return row.p if row else None


def speaker_turns(speech: DataFrame, speakers: DataFrame, max_pause_ms: int | None = None, texts: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """Turns of each job in order: job_id, speaker_id, first_seg_id, last_seg_id, start_ms, end_ms, text.

    ``speech`` holds usable rows with content and series_id; other columns are ignored. A turn is the longest
    stretch of spoken words by one person; with ``max_pause_ms`` a longer silence also ends it. Labels are
    matched against the people of the job's series: names in either order, parts and initials of
    them, roles, automatic numbers, without accents and case, and with one slip of a letter if that
    leaves one person. Text before any label of a job, and jobs without known people, give no turn.

    Null contents, rows without a spoken word and repeated deliveries change nothing
    (null ids are not repeats of each other); equal times are
    ordered by chunk_index, ord, seg_id; an empty input gives no row. What a rolling caption repeats of the end of
    the caption before it in its turn, two words or more, is cut from ``text`` only; without ``texts`` no text is made.

    A job too large for a task is cut into ranges, so a job of any length spreads over many tasks; turns open at
    a range's edge are joined from at most three fragments a range. ``sizes`` is where jobs are counted for that.
    """
    columns = [*ENTITY, *ORDER, "end_ms", "content", "series_id"]
    few = speakers.select("speaker_id", "series_id", "display_name", "role", "seat")
    known = few.limit(ROSTER_ROWS + 1).collect()
    people: Broadcast | None = None
    if len(known) <= ROSTER_ROWS:
        by_series: dict[int, list] = {}
        for r in known:
            if r.series_id is not None and r.speaker_id is not None:
                by_series.setdefault(r.series_id, []).append((r.speaker_id, r.display_name, r.role, r.seat))
        people = speech.sparkSession.sparkContext.broadcast(by_series)
    else:
        who = F.struct("speaker_id", "display_name", "role", "seat")
        listed = few.groupBy(F.col("series_id").alias("__series")).agg(F.collect_list(who).alias("roster"))
        speech = speech.join(listed, F.col("series_id") == F.col("__series"), "left")
        columns = [*columns, "roster"]
    spoken = speech.where(F.col("content").isNotNull()).select(*columns)
    found = cut(slices(spoken, ENTITY, ORDER, sizes).mapInArrow(_scan(people, max_pause_ms, texts), TURN_DDL))
    keep = ["job_id", "speaker_id", "first_seg_id", "last_seg_id", "start_ms", "end_ms", "text"]
    whole = found.where("not open_left and not open_right and speaker_id is not null").select(keep)
    w = Window.partitionBy("job_id").orderBy("slice", "part")
    filled = (
        found.where("open_left or open_right")
        .withColumn("speaker_id", F.last("speaker_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where("speaker_id is not null")
    )
    joined = F.lag("open_right").over(w) & F.col("open_left") & (F.lag("speaker_id").over(w) == F.col("speaker_id"))
    if max_pause_ms is not None:
        joined &= F.col("start_ms") - F.lag("end_ms").over(w) <= max_pause_ms
    numbered = filled.withColumn("fresh", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("n", F.sum("fresh").over(w))
    if texts:
        before = F.when(F.col("fresh") == 0, F.lag("tail").over(w))
        numbered = numbered.withColumn("before", before).withColumn("text", F.pandas_udf(_rolled, "string")("before", "head", "text"))
    at = F.struct("slice", "part")
    said = F.transform(F.array_sort(F.collect_list(F.struct("slice", "part", "text"))), lambda x: x["text"])
    stitched = (
        numbered.groupBy("job_id", "n")
        .agg(
            F.max("speaker_id").alias("speaker_id"),
            F.min_by("first_seg_id", at).alias("first_seg_id"),
            F.max_by("last_seg_id", at).alias("last_seg_id"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.array_join(F.filter(said, lambda t: t != ""), " ").alias("text") if texts else F.lit(None).cast("string").alias("text"),
        )
        .select(keep)
    )
    return whole.unionByName(stitched)
