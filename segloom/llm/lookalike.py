"""One form for texts that look the same though their characters differ."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.runtime import cut

#: Letters of other scripts that look like a Latin letter, chosen from the public list of confusable
#: characters; only those whose usual shapes are the same.
CYRILLIC = dict(zip("аеіјорсухѕԁԛԝһӏАВЕЅІЈКМНОРСТХУҮԌԚԜ", "aeijopcyxsdqwhlABESIJKMHOPCTXYYGQW", strict=True))
GREEK = dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovcjABEZHIKMNOPTYXCJ", strict=True))
ARMENIAN = dict(zip("օսհոցՕՍՏ", "ouhngOUS", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
GEORGIAN = {"Ⴝ": "S"}
#: Hyphens that look like the ASCII one.
HYPHENS = "‐‑﹣"
#: Letters that lose their dot under marks above, which stand for the dotted one with it.
DOTTED = {"ı\u0307": "i", "ȷ\u0307": "j"}
#: Characters without a shape of their own: soft hyphen, joiners, marks of direction, fillers, variation selectors.
INVISIBLE = (
    r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿"
)
_UNSEEN = regex.compile(f"[{INVISIBLE}]+")
#: Where a cluster has more than one character: marks and invisible ones after a base, and conjoining Hangul letters.
_SPECIAL = regex.compile(rf"[\p{{M}}{INVISIBLE}]+|[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{EMod}]")
JOINER, PICTURE_STYLE, KEYCAP = "\u200d", "\ufe0f", "\u20e3"
HANGUL = range(0xAC00, 0xAC00 + 11172)


def rules() -> dict[str, str]:
    """The mapping of single characters, made from rules of the character database and the fixed values above.

    Widths, presentation ligatures, Roman numerals and two-letter characters by their compatibility decomposition, every
    space of a fixed or non-breaking kind to the plain one, hyphens, and look-alike letters.
    """
    table: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if source != target and table.setdefault(source, target) != target:
            raise ValueError(f"conflicting rules for {source!r}")

    for code in range(0x80, 0x30000):
        c = chr(code)
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        plain = _UNSEEN.sub("", unicodedata.normalize("NFKC", c))
        name = unicodedata.name(c, "")
        two_letters = kind == "<compat>" and name.startswith("LATIN ") and len(plain) == 2 and plain.isalpha()
        if unicodedata.category(c) == "Zs":
            add(c, " ")
        elif kind in ("<wide>", "<narrow>") or 0xFB00 <= code <= 0xFB06 or two_letters:
            add(c, plain)
        elif kind == "<compat>" and name.startswith(("ROMAN NUMERAL", "SMALL ROMAN NUMERAL")):
            add(c, plain)
    for c in HYPHENS:
        add(c, "-")
    for letters in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, GEORGIAN):
        for c, target in letters.items():
            add(c, target)
    return checked(table)


def checked(table: dict[str, str]) -> dict[str, str]:
    """``table`` closed under itself: no target holds a source, so a second pass changes nothing."""
    for source, target in table.items():
        for _ in range(4):
            again = "".join(table.get(c, c) for c in target)
            if again == target:
                break
            target = again
        else:
            raise ValueError(f"rules go round from {source!r}")
        table[source] = target
    return table


def sequences(table: dict[str, str]) -> dict[str, str]:
    """The whole mapping, by decomposed source: ``table``, and every base with marks that has a composed form.

    A base may be given by anything whose output ends in it: the marks of a composed letter compose with that too.
    """
    alike: dict[str, list[tuple[str, str]]] = {}
    for source, target in table.items():
        if target and len(unicodedata.normalize("NFD", source)) == 1:
            alike.setdefault(target[-1], []).append((source, target[:-1]))
    for source, target in DOTTED.items():
        alike.setdefault(target, []).append((source, ""))
    out: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if out.setdefault(source, target) != target:
            raise ValueError(f"conflicting rules for {source!r}")

    for source, target in table.items():
        add(unicodedata.normalize("NFD", source), target)
    for code in range(0x80, 0x30000):
        c = chr(code)
        given = unicodedata.decomposition(c)
        if (not given or given.startswith("<")) and code not in HANGUL:
            continue
        source = unicodedata.normalize("NFD", c)
        target = unicodedata.normalize("NFC", source)
        if len(target) > 1 or len(source) == 1 or target in table or source[0] in table:
            continue  # without a composed form marks stay apart; a mapped base composes as what it is mapped to
        add(source, target)
        for base, before in alike.get(source[0], ()):
            marked = unicodedata.normalize("NFD", base) + source[1:]
            if unicodedata.normalize("NFD", marked) == marked:
                add(marked, before + target)
    for source, target in DOTTED.items():
        add(source, target)
    return out


class _Singles(dict):
    """Outputs of single characters by code; a character without a rule is learnt as its own, so it is missed but once."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


class Transducer:
    """A longest-match transducer over grapheme clusters, compiled into a trie of the mapping's sources.

    Clusters of one character, most of all, have their output compiled in beforehand; only those of several
    run through the trie, decomposed and without invisible characters.
    """

    def __init__(self, table: dict[str, str] | None = None, kept: int = 100_000):
        table = rules() if table is None else table
        self.root: dict = {}
        for source, target in sequences(table).items():
            node = self.root
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        self.kept = kept
        self.met: dict[str, str] = {}
        single = {ord(c): t for c, t in table.items()}
        for code in range(0x80, 0x30000):
            if code not in HANGUL and (given := unicodedata.decomposition(chr(code))) and not given.startswith("<"):
                single[code] = self.match(chr(code))
        self.single = _Singles((code, target) for code, target in single.items() if target != chr(code))

    def match(self, cluster: str) -> str:
        """Output of one cluster: at each place the longest source that fits, else the character itself."""
        text = unicodedata.normalize("NFD", _UNSEEN.sub("", cluster))
        out, at, n = [], 0, len(text)
        while at < n:
            node, best, end = self.root, text[at], at + 1
            for j in range(at, n):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    best, end = node[""], j + 1
            out.append(best)
            at = end
        return "".join(out)

    def _cluster(self, cluster: str) -> str:
        out = self.met.get(cluster)
        if out is None:
            if len(self.met) >= self.kept:
                self.met.clear()
            out = self.met[cluster] = self.match(cluster)
        return out

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        out: list[str] = []
        at = 0
        for m in _SPECIAL.finditer(text):
            start, end = m.span()
            marks = not "\u1100" <= m[0][0] <= "\u1112"
            begin = start - 1 if marks and start > at else start
            out.append(text[at:begin].translate(self.single))
            base = text[begin:start]
            if base and _PICTURE.match(base):
                # A picture keeps its style and its joiner, if another picture follows.
                joined = m[0].endswith(JOINER) and end < len(text) and _PICTURE.match(text[end])
                out.append(base + "".join(c for c in m[0] if c in (PICTURE_STYLE, KEYCAP) or not _UNSEEN.match(c)) + (JOINER if joined else ""))
            else:
                out.append(self._cluster(text[begin:end]))
            at = end
        out.append(text[at:].translate(self.single))
        return "".join(out)


_SHARED: list[Transducer] = []


def transducer() -> Transducer:
    """The worker's own compiled transducer."""
    if not _SHARED:
        _SHARED.append(Transducer())
    return _SHARED[0]


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = transducer()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array([None if t is None else run(t) for t in texts], pa.string())],
            names=["doc_id", "text", "normal_text"],
        )


def normalised(df: DataFrame) -> DataFrame:
    """doc_id, text and normal_text: equal for texts that look alike, different for texts that look different.

    Case, visible accents and digits stay; fractions, superscripts, quotes, dashes and line ends stay; zero-width
    joiners stay only inside emoji. Null stays null, empty stays empty, repeated rows stay, texts of any length
    are read whole, other columns are dropped. No shuffle.
    """
    return df.select("doc_id", "text").mapInArrow(_normal, "doc_id bigint, text string, normal_text string")


def _spelled(df: DataFrame) -> DataFrame:
    """doc_id with the 128-bit hashes of its text's common form and of the text itself; null and empty texts are left out."""
    digest = lambda c: F.unhex(F.md5(c))
    return cut(
        normalised(df.where("text is not null and text <> ''"))
        .where("normal_text <> ''")
        .select("doc_id", digest("normal_text").alias("form"), digest("text").alias("spelling"))
    )


def _classes(spelled: DataFrame) -> DataFrame:
    """Forms with more than one spelling: form, class_id, spellings, documents.

    Counted by spelling first, so that a form of very many documents costs a row a spelling.
    """
    by_spelling = spelled.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    by_form = by_spelling.groupBy("form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("documents"))
    return by_form.where("spellings > 1")


def alike_classes(df: DataFrame) -> DataFrame:
    """Documents whose text looks like a different string's: doc_id, class_id, same_as, spellings, documents.

    Documents that look alike have one ``class_id``, the least doc_id among them; exact copies also have one ``same_as``. Null and
    empty texts are no case, repeated rows are documents of their own, an empty input gives no row.
    The size of the result is that of the input, however many copies a form has.
    """
    spelled = _spelled(df)
    first = spelled.groupBy("spelling").agg(F.min("doc_id").alias("same_as"))
    return spelled.join(_classes(spelled), "form").join(first, "spelling").select("doc_id", "class_id", "same_as", "spellings", "documents")


def alike_pairs(df: DataFrame) -> DataFrame:
    """Pairs doc_id_a < doc_id_b whose texts look alike but are not the same string.

    Made from classes: spellings of one form are paired, one row each whatever their copies, and then joined with their
    documents by the spelling, so that a form of many documents is spread over its spellings and AQE splits those. The
    result names every pair, as its definition asks; :func:`alike_classes` says the same in one row a document.
    """
    spelled = _spelled(df)
    members = spelled.join(_classes(spelled).select("form"), "form", "left_semi").distinct()
    spellings = members.select("form", "spelling").distinct()
    one, two = (spellings.select("form", F.col("spelling").alias(c)) for c in ("one", "two"))
    pairs = one.join(two, "form").where("one < two").select("one", "two")
    a, b = (members.select(F.col("spelling").alias(c), F.col("doc_id").alias(d)) for c, d in (("one", "a"), ("two", "b")))
    found = pairs.join(a, "one").join(b, "two").where("a <> b")
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
