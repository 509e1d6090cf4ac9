"""Text of a file cut into documents by the task that reads it, which holds a part of the file at a time.

A file is read block by block and decoded by its byte order mark, by how its first bytes look, or by the encoding it
declares; first to see whether all of it can be read, then to cut it before every start tag. A document of more than
LONG characters is checked as a whole and handed on as several ones of the same records, each under the start tags
that it stood in. What a file gives is the same, however long the file, its documents and the blocks are.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyspark import cloudpickle

# The functions travel with the job, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Layout only: bytes read at a time, and characters from which on a text is handed on in parts.
BLOCK = 1 << 20
LONG = 1 << 20

UTF_8 = "UTF-8"

# What the first bytes of a file say (hex).
BYTE_ORDERS = [
    ("0000FEFF", "UTF-32BE"), ("FFFE0000", "UTF-32LE"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE"), ("EFBBBF", UTF_8),
    ("0000003C", "UTF-32BE"), ("3C000000", "UTF-32LE"), ("003C", "UTF-16BE"), ("3C00", "UTF-16LE"),
]

# A declared encoding of whole-word units cannot be true where the declaration itself was read byte by byte.
_DECLARED = re.compile(r"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._:-]+)["']""", re.ASCII)
_AS_UTF_8 = re.compile(r"(|utf-?8|us-ascii|ascii|utf-?16.*|utf-?32.*|ucs-?[24].*|iso-10646.*)", re.IGNORECASE | re.ASCII)

ROW_TAG = "AutomaticDestinations"
START, END = f"<{ROW_TAG}", f"</{ROW_TAG}>"
OUTSIDE, NOTHING, EMPTY, BROKEN = "outside any document", "no document", "empty file", "broken document"

_START = re.compile(rf"{START}[\s/>]", re.ASCII)
_ALONE = re.compile(rf"{START}[^<>]*/>")
_OPENING = re.compile(rf"{START}[^<>]*?(?=/*>|<|$)")
_INDEX = re.compile(r"[^\x00]{0,2000}?<autoFiles[\s/>]", re.ASCII)

# What may stand around documents and is nothing lost: closing tags, comments, instructions, blanks.
_AROUND = re.compile(r"</[^<>]*>|<!--.*?-->|<\?.*?\?>|\s+", re.ASCII | re.DOTALL)

# Where the records of a document are: the depth of their elements, and their names by that of the element around them.
CONTAINER = (3, {"DestList": "DestListEntryV2", "LNKs": "LNK"})
INDEX = (2, {"": "autoFile"})

# What a document says of its records: its own, and in the first one of a container those of all.
_OWN = {"ownEntries": "DestList", "ownLnks": "LNKs"}
_TAG = re.compile(rb"""<([^\s/>]+)(?:[^<>"']|"[^"]*"|'[^']*')*>""")
_TOLD = re.compile(rb"""\s+(ownEntries|ownLnks|allEntries|allLnks)\s*=\s*("[^"]*"|'[^']*')""")
_NUMBER = re.compile(r"\s*[+-]?[0-9]+\s*", re.ASCII)

# Parts are numbered from 0 within a text, `before` counts the records of the same kind in earlier parts, and `opening`
# is the start tag of a document whose part does not show it. The number is negative where an earlier part has the same
# `before`. Text that is no document has the reason.
PIECE = "part int, before bigint, opening string, text string, reason string"
Piece = tuple[int, int, str | None, str | None, str | None]


def encoding_of(first: bytes) -> str:
    """The encoding that a file's first bytes tell, UTF-8 unless they say otherwise."""
    for mark, name in BYTE_ORDERS:
        if first[:4].hex().upper().startswith(mark):
            return name
    declared = _DECLARED.match(first[:300].decode(UTF_8, "replace"))
    return UTF_8 if not declared or _AS_UTF_8.fullmatch(declared[1]) else declared[1].upper()


class Text:
    """A file's text, block by block, as often as it is asked for; `readable` tells whether the bytes are text of the
    encoding, and where they are not the blocks show what they can. A file of more than `whole` bytes is opened anew."""

    def __init__(self, opened: Callable, whole: int) -> None:
        self.opened, self.content, self.digest = opened, None, None
        with opened() as stream:
            first = b""
            while len(first) <= max(whole, 300) and (block := stream.read(max(whole, 300) + 1 - len(first))):
                first += block
        if len(first) <= whole:
            self.content = first
        self.encoding = encoding_of(first)
        self.length, found = 0, hashlib.sha256()
        for block in self._bytes():
            self.length += len(block)
            found.update(block)
        self.digest = found.hexdigest()
        self.readable = self._is_readable()

    def _bytes(self) -> Iterator[bytes]:
        if self.content is not None:
            yield from (self.content[at : at + BLOCK] for at in range(0, len(self.content), BLOCK))
            return
        found = hashlib.sha256()
        with self.opened() as stream:
            while block := stream.read(BLOCK):
                found.update(block)
                yield block
        if self.digest not in (None, found.hexdigest()):
            raise OSError("a file changed while it was read")

    def _decoded(self, encoding: str, errors: str) -> Iterator[str]:
        decoder = codecs.getincrementaldecoder(encoding)(errors)
        for block in self._bytes():
            yield decoder.decode(block)
        yield decoder.decode(b"", True)

    def _is_readable(self) -> bool:
        try:
            if not codecs.lookup(self.encoding)._is_text_encoding:
                return False
            for text in self._decoded(self.encoding, "strict"):
                text.encode()
        except (LookupError, ValueError):
            return False
        return True

    def blocks(self) -> Iterator[str]:
        """The text without its byte order mark."""
        start = True
        for text in self._decoded(self.encoding, "strict") if self.readable else self._decoded(UTF_8, "replace"):
            if start and text:
                start, text = False, text.removeprefix("\ufeff")
            if text:
                yield text


def _chunks(blocks: Iterator[str]) -> Iterator[tuple[bool, str, bool]]:
    """(begins, text, ends) of what lies between two start tags, in turn; in several rows if it is long."""
    held, begins, seek = "", True, 0
    for block in blocks:
        held += block
        begin = 0
        for found in _START.finditer(held, seek):
            if not (begins and found.start() == begin):
                yield begins, held[begin : found.start()], True
                begin, begins = found.start(), True
        held = held[begin:]
        # The end of a block may cut a start tag.
        if len(held) > LONG + len(START):
            yield begins, held[: -len(START)], False
            held, begins = held[-len(START) :], False
        seek = max(len(held) - len(START), 0)
    if held or not begins:
        yield begins, held, True


def _parts(texts: Iterator[str], reason: str | None, opening: str | None = None) -> Iterator[Piece]:
    """Text that is no document, in parts of at most LONG characters."""
    number, held = 0, ""
    for text in texts:
        held += text
        while len(held) > LONG:
            yield number, 0, opening if number else None, held[:LONG], reason
            number, held = number + 1, held[LONG:]
    if held or not number:
        yield number, 0, opening if number else None, held, reason


class _Around:
    """Whether a text that comes block by block is only what may stand around documents."""

    def __init__(self) -> None:
        self.held, self.lost, self.until = "", False, ""

    def feed(self, text: str) -> None:
        held, at = self.held + text, 0
        while not self.lost and at < len(held):
            if self.until:
                found = held.find(self.until, at)
                at = found + len(self.until) if found >= 0 else max(len(held) + 1 - len(self.until), at)
                if found < 0:
                    break
                self.until = ""
            elif found := _AROUND.match(held, at):
                at = found.end()
            elif held.startswith("<!--", at):
                at, self.until = at + 4, "-->"
            elif held.startswith("<?", at):
                at, self.until = at + 2, "?>"
            else:
                tag = held.startswith("</", at) and held.find("<", at + 1) < 0
                self.lost = not tag and held[at:] not in ("<", "<!", "<!-")
                if tag:
                    held, at = "</", 0
                break
        self.held = "" if self.lost else held[at:]

    def end(self) -> bool:
        return self.lost or bool(self.held) or bool(self.until)


class Cutter:
    """Reads a document and cuts it where records or the elements around them begin. Of an element around records
    that comes again the last one counts, as where documents are parsed."""

    def __init__(self, shape: tuple[int, dict[str, str]], seen: Cutter | None = None) -> None:
        self.depth_of_records, self.names = shape
        self.seen = seen
        # Prefixes need no declaration, as where documents are parsed.
        self.parser = expat.ParserCreate("utf-8")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.held, self.base, self.begin = b"", 0, 0
        self.depth, self.open, self.prefix = 0, [], b""
        self.kind, self.record, self.met, self.total = "", self.names.get(""), Counter(), Counter()
        self.count = self.first = self.number = 0
        self.told: dict[str, int] = {}
        self.firsts: set[int] = set()
        self.pieces: list[Piece] = []
        self.ended = self.broken = False

    def feed(self, text: str, last: bool = False) -> list[Piece]:
        """The pieces that are ready."""
        if not (self.ended or self.broken):
            data = text.encode()
            self.held += data
            try:
                self.parser.Parse(data, last)
            except expat.ExpatError:
                self.broken = not self.ended
            self.held = self.held[self.begin - self.base :]
            self.base = self.begin
        self.broken |= last and not self.ended
        ready, self.pieces = self.pieces, []
        return ready

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        self.depth += 1
        if self.depth > self.depth_of_records or self.ended:
            return
        at = self.parser.CurrentByteIndex
        if self.depth == self.depth_of_records:
            if at - self.begin >= LONG:
                self._cut(at)
            if self.record and name == self.record:
                self.count += 1
            return
        if self.depth > 1:
            # A part has records of one kind, so that one number tells how many come before them.
            if self.count > self.first:
                self._cut(at)
            self.kind = name
            self.record = self.names.get(self.kind)
            self.met[self.kind] += 1
            self.count = self.first = 0
        else:
            self.told = {name: int(value) for name, value in attributes.items() if name in _OWN and _NUMBER.fullmatch(value)}
        tag = _TAG.match(self.held, at - self.base)
        self.open.append((tag[0], tag[1]))

    def _end(self, name: str) -> None:
        if self.depth < self.depth_of_records and not self.ended:
            self.open.pop()
            self.total[self.kind] = self.count
            if self.depth == 1:
                self.ended = True
                at = self.parser.CurrentByteIndex - self.base
                self._cut(self.base + (self.held.index(b">", at) + 1 if self.held[at : at + 2] == b"</" else at))
        self.depth -= 1

    def _cut(self, at: int) -> None:
        text = self.prefix + self.held[self.begin - self.base : at - self.base] + b"".join(b"</" + name + b">" for _, name in reversed(self.open))
        if self.seen and (self.kind not in self.names or self.seen.met[self.kind] == self.met[self.kind]):
            if self.depth_of_records > 2:
                text = self._declared(text)
            number = -self.number if self.first in self.firsts else self.number
            self.pieces.append((number, self.first, None, text.decode(), None))
            self.firsts.add(self.first)
            self.number += 1
        self.begin, self.first = at, self.count
        self.prefix = b"".join(tag for tag, _ in self.open)

    def _declared(self, text: bytes) -> bytes:
        """The start tag says what this part holds; that it held other numbers than it said is left to the first part."""
        tag = _TAG.match(text)[0]
        stays = re.sub(_TOLD, lambda m: b"" if self.number or m[1].decode() in _OWN else m[0], tag)
        for name, kind in _OWN.items():
            if name in self.told:
                own = self.count - self.first if kind == self.kind else 0
                own += 0 if self.number else self.told[name] - self.seen.total[kind]
                stays = re.sub(rb"\s*/?>$", b"", stays) + f' {name}="{own}"'.encode() + (b"/>" if tag.endswith(b"/>") else b">")
        return stays + text[len(tag) :]


@dataclass
class _Long:
    """What is known of a long chunk: the document's length, whether it can be parsed, and what is behind it."""

    cutter: Cutter
    end: int | None = None
    damaged: bool = False
    lost: bool = False
    rest_damaged: bool = False


def _document_end(text: str) -> int:
    """Where the document ends that a chunk begins with; 0 if that cannot be told."""
    at = text.find(END)
    if at >= 0:
        return at + len(END)
    alone = _ALONE.match(text)
    return alone.end() if alone else 0


def _until_end(texts: Iterator[str]) -> Iterator[tuple[bool, str]]:
    """(of the document, text) of a chunk's texts, cut behind its end tag; a text is held back until it shows none."""
    held, inside = "", True
    for text in texts:
        if not inside:
            yield False, text
            continue
        held += text
        at = held.find(END)
        if at >= 0:
            yield True, held[: at + len(END)]
            inside, held = False, held[at + len(END) :]
            yield False, held
        else:
            yield True, held[: -len(END)]
            held = held[-len(END) :]
    if inside:
        yield True, held


def _look(texts: Iterator[str]) -> _Long:
    """A long chunk that begins with a document, read once."""
    known = _Long(Cutter(CONTAINER))
    around, length, closed, alone = _Around(), 0, False, 0
    rest_of_alone, damaged_after_alone, damaged_before = _Around(), False, False
    for inside, text in _until_end(texts):
        if inside:
            if not length and text:
                found = _ALONE.match(text)
                alone = found.end() if found else 0
                damaged_before = "\ufffd" in text[:alone]
                text_after = text[alone:]
            else:
                text_after = text
            if alone:
                rest_of_alone.feed(text_after)
                damaged_after_alone |= "\ufffd" in text_after
            length += len(text)
            known.damaged |= "\ufffd" in text
            known.cutter.feed(text)
        else:
            closed = True
            around.feed(text)
            known.rest_damaged |= "\ufffd" in text
    known.cutter.feed("", True)
    if closed:
        known.end, known.lost = length, around.end()
    elif alone:
        known.end, known.lost = alone, rest_of_alone.end()
        known.damaged, known.rest_damaged = damaged_before, damaged_after_alone
    return known


def _short(text: str, unread: Callable[[str], str | None]) -> Iterator[Piece]:
    """A document that a short chunk begins with, and what comes after it where that is more than closing tags."""
    end = _document_end(text) or len(text)
    yield 0, 0, None, text[:end], unread(text[:end])
    if _AROUND.sub("", text[end:]):
        yield 0, 0, None, text[end:], unread(text[end:]) or OUTSIDE


def _long(texts: Iterator[str], known: _Long, unread: Callable[[str], str | None]) -> Iterator[Piece]:
    """The same of a long chunk."""
    end = known.end
    first = None

    def split(texts: Iterator[str]) -> Iterator[tuple[bool, str]]:
        at = 0
        for text in texts:
            inside = len(text) if end is None else max(min(end - at, len(text)), 0)
            at += len(text)
            if inside:
                yield True, text[:inside]
            if inside < len(text):
                yield False, text[inside:]

    rows = split(texts)
    after: list[str] = []

    def document() -> Iterator[str]:
        nonlocal first
        for inside, text in rows:
            if first is None:
                first = _OPENING.match(text)[0]
            if not inside:
                after.append(text)
                return
            yield text

    def rest() -> Iterator[str]:
        yield from after
        for _, text in rows:
            yield text

    mark = unread("\ufffd" if known.damaged else "")
    reason = mark or (BROKEN if known.cutter.broken else None)
    if reason:
        for number, before, _, text, why in _parts(document(), reason):
            yield number, before, first if number else None, text, why
    else:
        cutter = Cutter(CONTAINER, known.cutter)
        for text in document():
            yield from cutter.feed(text)
        yield from cutter.feed("", True)
    if known.lost:
        yield from _parts(rest(), unread("\ufffd" if known.rest_damaged else "") or OUTSIDE)


def _grouped(blocks: Iterator[str]) -> Iterator[tuple[bool, Iterator[str]]]:
    """(long, texts) of each chunk; its texts are to be read before the next one is asked for."""
    rows = _chunks(blocks)
    for _, text, ends in rows:

        def texts(text: str = text, ends: bool = ends) -> Iterator[str]:
            yield text
            while not ends:
                _, text, ends = next(rows)
                yield text

        found = texts()
        yield not ends, found
        for _ in found:
            pass


def containers(text: Text) -> Iterator[Piece]:
    """All documents of a file, and what is no document with the reason; an index file has one piece without text."""
    longs: dict[int, _Long] = {}
    documents = head = odd = blank = index = None
    for number, (is_long, texts) in enumerate(_grouped(text.blocks())):
        first = next(texts)
        if _START.match(first):
            documents = True
            if is_long:

                def again(first: str = first, texts: Iterator[str] = texts) -> Iterator[str]:
                    yield first
                    yield from texts

                longs[number] = _look(again())
        else:
            # What stands before all documents.
            head, index, blank, tail = True, bool(_INDEX.match(first[:2100])), not first.strip(" "), first[-len(ROW_TAG) :]
            odd = ROW_TAG in first
            for more in texts:
                blank = blank and not more.strip(" ")
                odd = odd or ROW_TAG in tail + more
                tail = more[-len(ROW_TAG) :]
    unreadable = None if text.readable else f"cannot be read as {text.encoding}"

    def unread(of: str) -> str | None:
        # Of a file that is not all UTF-8, a document counts if nothing in it was replaced.
        return unreadable if unreadable and (text.encoding != UTF_8 or "\ufffd" in of) else None

    if not documents:
        if index:
            yield 0, 0, None, None, None
        else:
            yield from _parts(text.blocks(), EMPTY if blank or not head else unreadable or NOTHING)
        return
    for number, (is_long, texts) in enumerate(_grouped(text.blocks())):
        if number == 0 and head:
            if odd:
                yield from _parts(texts, OUTSIDE)
        elif number in longs:
            yield from _long(texts, longs[number], unread)
        else:
            yield from _short("".join(texts), unread)


def index_entries(text: Text) -> Iterator[Piece]:
    """An index file as it is, or a long one in parts; one that cannot be parsed gives nothing then."""
    held, seen = "", None
    for block in text.blocks():
        if seen is None:
            held += block
            if len(held) > LONG:
                seen = Cutter(INDEX)
                seen.feed(held)
        else:
            seen.feed(block)
    if seen is None:
        yield 0, 0, None, held, None
        return
    seen.feed("", True)
    if not seen.broken:
        cutter = Cutter(INDEX, seen)
        for block in text.blocks():
            yield from cutter.feed(block)
        yield from cutter.feed("", True)
