"""Text decoded with the wrong encoding (problem 10).

Garbled sequences are computed beforehand for all encoding pairs. Where UTF-8 was read with a single-byte encoding, each
character gives a sequence of its own; a multi-pattern automaton finds these, and only matched spans are replaced. Where one single-byte
encoding was read as another, a character maps to one character, which proves nothing alone; there a run of characters is replaced if the
restored characters are far more usual between such neighbours than the ones that stand there. What is usual is counted over all
distinct texts, so that copies of a garbled text don't make it usual, and over all documents (frequencies of a character between two
classes of neighbours, tables bounded by the repertoire); either may prove the damage.
U+FFFD marks loss that can't be undone.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Single-byte encodings that text is commonly written in or read with, the likeliest first.
ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-9", "iso8859-15", "cp852", "cp866", "koi8-r", "iso8859-5", "cp1253", "cp1257", "mac_latin2", "mac_turkish", "mac_cyrillic", "koi8-u")
#: Code point ranges of the characters whose garbled forms are looked for.
REPERTOIRE = ((0x80, 0x17F), (0x218, 0x21B), (0x2C6, 0x2DD), (0x391, 0x3C9), (0x401, 0x45F), (0x490, 0x491), (0x1E9E, 0x1E9E), (0x2010, 0x2027), (0x202F, 0x203A), (0x20A0, 0x20BF), (0x2116, 0x2126), (0x2190, 0x2199), (0x2200, 0x2265), (0x2500, 0x26FF), (0x2700, 0x27BF), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0x1F300, 0x1F6FF))
#: Code point ranges of further scripts, looked for in whole sequences only; and of ideographs and syllables, which are too many to list and are known by their form.
SCRIPTS = ((0x180, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x5B0, 0x5F4), (0x60C, 0x6FF), (0x900, 0x97F), (0xE01, 0xE5B), (0x1E00, 0x1EFF), (0x1F00, 0x1FFE), (0x2000, 0x206F), (0x2150, 0x218F), (0x3000, 0x30FF), (0xFF01, 0xFFEE), (0x1F700, 0x1FAFF))
WIDE = ((0x900, 0xDFF), (0x1000, 0x11FF), (0x3105, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
#: Encodings with several bytes to a character, and the single-byte ones these are most often read with.
MULTIBYTE = ("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
READ_WITH = ("cp1252", "latin-1", "mac_roman", "cp437")
LOST = "�"
#: A run is replaced if its restored form is so many times more usual, and a document reported from so many times.
RUN_GAIN, DOC_GAIN = math.log(20), math.log(60)
#: The same for each character where bytes of several characters are put together.
SPLIT_GAIN = math.log(5)
#: Overlapping finds in padded texts: each non-ASCII character, or run of them, with the characters on both sides.
TRIPLE, AROUND = re.compile(r"(?s)(?=(.[^\x00-\x7f].))"), re.compile(r"(?s)(?=([\x00-\x7f][^\x00-\x7f]+[\x00-\x7f]))")
RUN, PAIRED, LONG_RUN = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f]{2,}"), re.compile(r"[^\x00-\x7f]{3,}")
SOFT_HYPHEN = "\xad"
FAR_EAST = re.compile("[\u0900-\u11ff\u2e80-\ufaff\U00020000-\U0002fa1f]")
CYRILLIC = re.compile("[Ѐ-ӿ]+")
#: Prefix of contexts counted outside of garbled sequences only: what garbled text brings along doesn't make itself usual.
APART = "\0"


@lru_cache
def table(encoding: str) -> tuple[str, ...]:
    """Character of each byte; bytes the encoding doesn't define become control characters, as browsers read them."""
    out = []
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
            out.append(c if len(c) == 1 else chr(b))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache
def automaton():
    """Aho-Corasick automaton of all garbled UTF-8 sequences; a sequence's value maps encodings to the character it was."""
    import ahocorasick

    known: dict[str, dict[str, str]] = {}
    for encoding in ENCODINGS:
        chars = table(encoding)
        for low, high in REPERTOIRE + SCRIPTS:
            for code in range(low, high + 1):
                c = chr(code)
                if unicodedata.category(c) == "Cn":
                    continue
                raw = c.encode("utf-8")
                garbled = "".join(chars[b] for b in raw)
                forms = {garbled}
                if len(raw) > 2 and (low, high) in REPERTOIRE:  # long sequences are still recognised without their undefined bytes
                    without = "".join(x for x in garbled if not 0x80 <= ord(x) < 0xA0)
                    if 2 <= len(without) < len(garbled) and ord(without[0]) > 0xBF:
                        forms.add(without)
                for g in forms:
                    if g.isascii() or ((low, high) in SCRIPTS and CYRILLIC.fullmatch(g)):  # the latter are syllables of ordinary words
                        continue
                    known.setdefault(g, {}).setdefault(encoding, c)
    a = ahocorasick.Automaton()
    for g, by in known.items():
        a.add_word(g, (len(g), by))
    a.make_automaton()
    return a


@lru_cache
def bytes_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(table(encoding)) if b > 127}


@lru_cache
def wide_forms() -> re.Pattern:
    """Sequences that have the form of a garbled three- or four-byte character in some encoding."""
    parts = []
    for e in ENCODINGS:
        t = table(e)
        if sum(CYRILLIC.match(c) is not None for c in t[0x80:0xC0]) > 10:  # ordinary words have this form
            continue
        part = lambda low, high: "[" + re.escape("".join(t[low : high + 1])) + "]"  # noqa: B023, E731
        parts += [part(0xE0, 0xEF) + part(0x80, 0xBF) + "{2}", part(0xF0, 0xF4) + part(0x80, 0xBF) + "{3}"]
    return re.compile("|".join(dict.fromkeys(parts)))


@lru_cache
def wide_hint() -> re.Pattern:
    """What any of these forms begins with, whatever the encoding; quicker to look for."""
    tables = [t for t in map(table, ENCODINGS) if sum(CYRILLIC.match(c) is not None for c in t[0x80:0xC0]) <= 10]
    of = lambda low, high: "[" + re.escape("".join(sorted({c for t in tables for c in t[low : high + 1]}))) + "]"
    return re.compile(of(0xE0, 0xF4) + of(0x80, 0xBF) + "{2}")


@lru_cache(maxsize=100_000)
def wide_reading(form: str) -> tuple[tuple[str, str], ...]:
    """(encoding, character) of the ideographs and syllables that a sequence may have been."""
    out = []
    for e in ENCODINGS:
        known = bytes_of(e)
        if all(c in known for c in form):
            try:
                c = bytes(known[x] for x in form).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and any(low <= ord(c) <= high for low, high in WIDE) and unicodedata.category(c) != "Cn":
                out.append((e, c))
    return tuple(out)


def sequences(text: str) -> list[tuple[int, int, dict[str, str]]]:
    """Garbled UTF-8 sequences in order: begin, end and the character by encoding. Where the automaton's overlap with wide characters, the first and longest counts."""
    find, hits, wide = automaton(), [], []
    # a sequence has two characters at least, none of them ASCII
    for run in PAIRED.finditer(text):
        begin, end = run.span()
        hits += [(at - size + 1, at + 1, by) for at, (size, by) in find.iter_long(text, begin, end)]
        if end - begin > 2 and wide_hint().search(text, begin, end):
            wide += [(m.start(), m.end(), dict(r)) for m in wide_forms().finditer(text, begin, end) if (r := wide_reading(m.group()))]
    if not wide:
        return hits
    hits = [(at - size + 1, at + 1, by) for at, (size, by) in find.iter(text)]
    out, at = [], 0
    for h in sorted([*hits, *wide], key=lambda h: (h[0], -h[1])):
        if h[0] >= at:
            out.append(h)
            at = h[1]
    return out


def undo_utf8(text: str, usual: dict[str, int]) -> tuple[str, int]:
    """Replace garbled UTF-8 sequences (longest first), choosing between readings by what most spans of the text agree on; again for text garbled twice.

    A sequence whose characters are, apart from such sequences, far more usual where they stand than what they would become (letters of a Cyrillic
    word, say) is left, and so are line drawings that are no less usual than the result.
    """
    spans = 0
    while True:  # every round shortens the text
        hits = sequences(text)
        if not hits:
            break
        votes = Counter(e for _, _, by in hits for e in by)
        bests = [by[max(by, key=lambda e: (votes[e], -ENCODINGS.index(e)))] for _, _, by in hits]
        verdicts = []
        for k, (begin, end, _) in enumerate(hits):
            best = bests[k]
            stands = min(usual.get(APART + c, 0) for c in contexts(text, begin, end))
            before = bests[k - 1] if k and hits[k - 1][1] == begin else text[max(0, begin - 1) : begin]
            after = bests[k + 1] if k + 1 < len(hits) and hits[k + 1][0] == end else text[end : end + 1]
            around = neighbour_class(before) + best + neighbour_class(after)
            drawing = all("─" <= c <= "▟" for c in text[begin:end])
            becomes = usual.get(APART + around, 0)
            verdicts.append(not ((drawing and stands >= becomes) or stands > 8 * (becomes + 0.5)))
        # sequences that touch are one garbled word: most of them decide
        chain = [0]
        for k in range(1, len(hits)):
            chain.append(chain[-1] + (hits[k - 1][1] != hits[k][0]))
        garbled = Counter(c for c, v in zip(chain, verdicts) if v)
        size = Counter(chain)
        out, at, done = [], 0, 0
        for k, (begin, end, _) in enumerate(hits):
            if 2 * garbled[chain[k]] <= size[chain[k]] and not (verdicts[k] and size[chain[k]] == 2):
                continue
            spans += 1
            # half of another sequence left beside it tells that this one is misread: the damage is reported, the text left as it is
            if (begin and 0x80 <= ord(text[begin - 1]) < 0xA0 and not (k and hits[k - 1][1] == begin)) or (end < len(text) and (0x80 <= ord(text[end]) < 0xA0 or text[end] == SOFT_HYPHEN) and not (k + 1 < len(hits) and hits[k + 1][0] == end)):
                continue
            out += [text[at:begin], bests[k]]
            at = end
            done += 1
        if not done:
            break
        out.append(text[at:])
        text = "".join(out)
    return text, spans


def neighbour_class(c: str) -> str:
    if not c or c.isspace():
        return "s"
    if c.isascii():
        return "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "p"
    if "Ѐ" <= c <= "џ":
        return "c" if c.islower() else "C"
    return "l" if c.islower() else "u" if c.isupper() else "n"


@lru_cache(maxsize=200_000)
def _context(around: str) -> str:
    return neighbour_class(around[0]) + around[1] + neighbour_class(around[2])


def contexts(text: str, begin: int, end: int) -> Iterator[str]:
    """Keys of the non-ASCII characters text[begin:end]: class before, character, class after."""
    for i in range(begin, end):
        around = text[i - 1 : i + 2] if i else " " + text[:2]
        yield _context(around if len(around) == 3 else around + " ")


@lru_cache
def counted() -> frozenset[str]:
    """Characters whose contexts are counted: those of the encodings and of the repertoire, about 8,000, and ideographs and syllables."""
    wide = (chr(x) for low, high in WIDE for x in range(low, high + 1))
    return frozenset(wide) | known_characters()


def known_characters() -> frozenset[str]:
    return frozenset(c for e in ENCODINGS for c in table(e) if not c.isascii()) | frozenset(chr(x) for low, high in REPERTOIRE + SCRIPTS for x in range(low, high + 1))


def usual_contexts(documents: DataFrame, text: str) -> tuple[tuple[dict[str, int], int], tuple[dict[str, int], int]]:
    """Frequency of each context (again, with `APART`, outside of garbled sequences) and the number of texts: over distinct texts, and over documents.

    At most 2 x (characters of Unicode's scripts) x 8 x 8 entries, in practice some ten thousand, however many documents there are.
    """
    t = F.col(text)
    # ASCII texts are only counted, so their text isn't shuffled
    source = documents.where(t.isNotNull()).select(F.md5(t).alias("h"), F.when(F.octet_length(t) > F.length(t), t).alias("text")).groupBy("h").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("text", "copies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counted()
        once: Counter[str] = Counter()
        total: Counter[str] = Counter()
        for b in batches:
            for t, copies in zip(b.column("text").to_pylist(), b.column("copies").to_pylist()):
                found = {""}
                if t is not None:
                    padded = f" {t} "
                    keys = lambda triples: {k for k in map(_context, triples) if k[1] in known}
                    found |= keys(set(TRIPLE.findall(padded)))
                    apart, at = set(), 0
                    for begin, end, _ in [*sequences(t), (len(t), len(t), {})]:
                        if begin > at:
                            apart.update(TRIPLE.findall(padded, at, begin + 2))
                        at = end
                    found.update(APART + k for k in keys(apart))
                for k in found:
                    once[k] += 1
                    total[k] += copies
        yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.string()), pa.array(list(once.values()), pa.int64()), pa.array([total[k] for k in once], pa.int64())], ["key", "once", "total"])

    rows = source.mapInArrow(count, "key string, once long, total long").groupBy("key").agg(F.sum("once").alias("once"), F.sum("total").alias("total")).collect()
    once, total = {r.key: r.once for r in rows}, {r.key: r.total for r in rows}
    return (once, once.pop("", 0)), (total, total.pop("", 0))


def most_usual_forms(usual: dict[str, int]) -> dict[str, float]:
    """For each character the logarithm of the greatest frequency, over all neighbours, of what it may stand for: a bound of any gain."""
    best: dict[str, int] = {}
    for k, c in usual.items():
        if k[0] == APART and len(k) == 4:
            best[k[2]] = max(best.get(k[2], 0), c)
    out: dict[str, float] = {}
    for _, _, m in pair_maps():
        for w, t in m.items():
            out[w] = max(out.get(w, -math.inf), math.log(best.get(t, 0) + 0.5))
    return out


@lru_cache
def pair_maps() -> tuple[tuple[str, str, dict[str, str]], ...]:
    """(true encoding, wrong encoding, character map) of all pairs that differ."""
    out = []
    for true, wrong in itertools.permutations(ENCODINGS, 2):
        m = {w: t for b, (t, w) in enumerate(zip(table(true), table(wrong))) if b > 127 and t != w and not 0x80 <= ord(t) < 0xA0}
        if m:
            out.append((true, wrong, m))
    return tuple(out)


@lru_cache(maxsize=10_000)
def targets(c: str) -> tuple[str, ...]:
    """What a character becomes under each pair; itself where the pair doesn't change it."""
    return tuple(m.get(c, c) for _, _, m in pair_maps())


#: A character among blanks is no evidence unless what it would be is as usual there as in this share of all documents.
ALONE = 0.25
REPEATED = re.compile(r"(.)\1\1")


def readings(before: str, run: str, after: str, usual: dict[str, int], forms: dict[str, float], known: dict) -> dict[int, tuple[str, float, int]]:
    """By index of the pair: restored run, gain (at least `RUN_GAIN`) and least frequency. Depends on the neighbours' classes only, so it is kept in ``known``."""
    key = (neighbour_class(before), run, neighbour_class(after))
    if key in known:
        return known[key]
    text = before + run + after
    logs = [math.log(usual.get(k, 0) + 0.5) for k in contexts(text, len(before), len(before) + len(run))]
    out: dict[int, tuple[str, float, int]] = {}
    if REPEATED.search(run) is None and sum(max(0.0, forms.get(c, -math.inf) - s) for c, s in zip(run, logs)) >= RUN_GAIN:
        gains: dict[tuple, tuple[str, float, int] | None] = {tuple(run): None}
        for p, new in enumerate(zip(*map(targets, run))):
            if new not in gains:
                changed = "".join(new)
                counts = [usual.get(APART + k, 0) for k in contexts(before + changed + after, len(before), len(before) + len(changed))]
                gain = sum(math.log(c + 0.5) for c in counts) - sum(logs)
                gains[new] = (changed, gain, min(counts)) if gain >= RUN_GAIN else None
            if gains[new] is not None:
                out[p] = gains[new]
    if len(known) < 100_000:
        known[key] = out
    return out


def undo_single(text: str, arounds: set[str], usual: dict[str, int], n: int, forms: dict[str, float], known: dict) -> tuple[str, int]:
    """Replace runs that read as another single-byte encoding; of all pairs the one that explains the text best.

    Evidence are runs whose restored form is far more usual, however usual they are themselves. A character repeated three times is a drawing, and a lone one
    between blanks counts only for what is very usual there (a dash); both are replaced only in texts that other runs prove garbled.
    ``arounds`` (the runs with their neighbours), ``forms`` (see `most_usual_forms`) and ``known`` only spare work.
    """
    if all(known.get(a) == {} for a in arounds):
        return text, 0
    runs = []
    for m in RUN.finditer(text):
        b, e = m.span()
        around = (text[b - 1 : b] or "\n") + m.group() + (text[e : e + 1] or "\n")
        by = known.get(around)
        if by is None:
            by = readings(text[max(0, b - 1) : b], m.group(), text[e : e + 1], usual, forms, known)
            if len(known) < 300_000:
                known[around] = by
        runs.append((b, e, by))
    evidence: Counter[int] = Counter()
    gained: Counter[int] = Counter()
    for b, e, by in runs:
        if not by:
            continue
        alone = (not b or text[b - 1].isspace()) and (e == len(text) or text[e].isspace())
        for p, (_, gain, least) in by.items():
            gained[p] += gain
            evidence[p] += gain if not alone or least >= ALONE * n else 0.0
    if not evidence:
        return text, 0
    best: tuple[float, list[tuple[int, int, str]]] = (-math.inf, [])
    for p in sorted(p for p in evidence if evidence[p] >= DOC_GAIN):
        m, total, found = pair_maps()[p][2], gained[p], []
        for b, e, by in runs:
            if p in by:
                found.append((b, e, by[p][0]))
                continue
            # sound runs beside garbled ones only decide between pairs
            new = "".join(m.get(c, c) for c in text[b:e])
            if new != text[b:e] and REPEATED.search(text[b:e]) is None:
                around = text[max(0, b - 1) : b] + new + text[e : e + 1]
                after = sum(math.log(usual.get(APART + k, 0) + 0.5) for k in contexts(around, min(b, 1), min(b, 1) + len(new)))
                total += min(after - sum(math.log(usual.get(k, 0) + 0.5) for k in contexts(text, b, e)), 0.0) * 0.1
        if total > best[0] + 1e-9:
            best = (total, found)
    out, at = [], 0
    for b, e, new in best[1]:
        out += [text[at:b], new]
        at = e
    return "".join([*out, text[at:]]), len(best[1])


def undo_either(text: str, tables: list[tuple]) -> tuple[str, int]:
    arounds = set(AROUND.findall(f"\n{text}\n"))
    for t in tables:
        fixed, runs = undo_single(text, arounds, *t)
        if runs:
            return fixed, runs
    return text, 0


def swallowed(run: str) -> str | None:
    """What a run was, if it is UTF-8 read with an encoding of several bytes to a character, which hardly succeeds by chance."""
    if len(run) > 1 and FAR_EAST.search(run):
        for wrong in MULTIBYTE:
            try:
                new = run.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
            if new != run and all(unicodedata.category(c) not in ("Cn", "Co", "Cc") for c in new):
                return new
    return None


def split_up(run: str, usual: dict[str, int]) -> str | None:
    """What a run was, if it is text in such an encoding read with a single-byte one; chance allows that too, so the result must be far more usual in the corpus."""
    if len(run) < 6:
        return None
    letters, stands = set(run), None
    for wrong in READ_WITH:
        known = bytes_of(wrong)
        if not letters <= known.keys():
            continue
        if stands is None:
            stands = sum(math.log(usual.get(k, 0) + 0.5) for k in contexts(run, 0, len(run)))
        for true in MULTIBYTE:
            try:
                new = bytes(known[c] for c in run).decode(true)
            except UnicodeError:
                continue
            becomes = sum(math.log(usual.get(APART + k, 0) + 0.5) for k in contexts(new, 0, len(new)))
            if becomes / len(new) - stands / len(run) >= SPLIT_GAIN and becomes - stands >= DOC_GAIN:
                return new
    return None


#: A run with the ASCII characters that may have been swallowed as second bytes.
MULTIBYTE_RUN = re.compile(r"[^\x00-\x7f]+[0-9A-Za-z@-~]?(?:[^\x00-\x7f]+[0-9A-Za-z@-~]?)*")


def undo_swallowed(text: str) -> tuple[str, int]:
    runs = 0

    def restored(m: re.Match) -> str:
        nonlocal runs
        whole = m.group()
        for run in dict.fromkeys((whole, *RUN.findall(whole))):
            new = swallowed(run)
            if new is not None:
                runs += 1
                whole = whole.replace(run, new)
        return whole

    return MULTIBYTE_RUN.sub(restored, text), runs


def undo_split(text: str, usual: dict[str, int]) -> tuple[str, int]:
    runs = 0

    def restored(m: re.Match) -> str:
        nonlocal runs
        new = split_up(m.group(), usual)
        runs += new is not None
        return m.group() if new is None else new

    return LONG_RUN.sub(restored, text), runs


def repair(text: str, tables: list[tuple]) -> tuple[str, int, int, bool]:
    """With what is usual among distinct texts and among documents: (restored text, garbled UTF-8 spans, garbled single-byte runs, whether something is lost)."""
    if text.isascii() and "&" not in text:
        return text, 0, 0, False
    fixed, parts = undo_split(text, tables[-1][0])
    fixed, multi = undo_utf8(fixed, tables[-1][0])
    fixed, single = undo_either(fixed, tables)
    if not multi and not single and not parts and FAR_EAST.search(fixed):
        fixed, parts = undo_swallowed(fixed)
    single += parts
    lost = LOST in text
    if not multi and not single and not lost and "&" in text and (plain := html.unescape(text)) != text:
        # garbled first and escaped for the web later: escaping alone is no damage
        undone, multi = undo_utf8(plain, tables[-1][0])
        undone, single = undo_either(undone, tables)
        lost = LOST in plain
        if multi or single or lost:
            fixed = undone
    return fixed, multi, single, lost


def garbled_documents(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Affected documents: ``doc_id, utf8_spans, single_runs, lost, restored``.

    ``restored`` is the whole text with the matched spans replaced, else untouched; ``lost`` tells that it still has characters that can't be
    restored. Null, empty and blank texts are never affected; text merely escaped for the web isn't either. Repeated rows are judged alike.
    """
    tables = [(usual, n, most_usual_forms(usual), {}) for usual, n in usual_contexts(documents, text)]
    # plain ASCII without escapes can't be garbled and doesn't leave the JVM
    source = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text is not null and (octet_length(text) > length(text) or contains(text, '&'))")
    shared = source.sparkSession.sparkContext.broadcast(tables)
    kind = documents.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in batches:
            rows = [(i, *repair(t, tables)) for i, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist())]
            rows = [r for r in rows if r[2] or r[3] or r[4]]
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], b.schema.field("doc").type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.bool_()), pa.array(columns[1], pa.string())],
                ["doc", "utf8_spans", "single_runs", "lost", "restored"],
            )

    return source.mapInArrow(judge, f"doc {kind}, utf8_spans int, single_runs int, lost boolean, restored string").withColumnRenamed("doc", doc_id)
