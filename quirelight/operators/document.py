"""What is sequential within one document: typographic line blocks, authors, titles, abstracts.

Pure functions on small objects; `quirelight.plans.recognize` applies them to Arrow batches, one
document a row, so that no shuffle is needed for any of them. Evidence about names needs a registry:
`heads_of` lists what may be chosen without it, `chosen_title` chooses with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

from quirelight.functions.text import CONJUNCTIONS, DEGREES, STRUCTURED_HEADINGS, is_alphabetic, normalize_text

#: Limits of the data model.
MAX_BLOCKS, MAX_LINE_CHARS, TITLE_BYTES = 500, 500, 300
#: Bytes of a block's text that are judged as a title, and looked up.
JUDGED_BYTES, LOOKUP_BYTES = 500, 1024
#: An abstract of as many bytes is given up.
ABSTRACT_BYTES = 8192
#: Title lookups after which no further block of a document is tried.
MOST_LOOKUPS = 100
#: Code points with the property Hyphen.
HYPHENS = "-\u00ad\u058a\u1806\u2010\u2011\u2e17\u30fb\ufe63\uff0d\uff65"


def size_of(text: str) -> int:
    """Bytes in UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


class Word(NamedTuple):
    x_min: float
    y_min: float
    x_max: float
    y_max: float
    size: float
    space: bool
    baseline: float
    bold: bool
    font: int
    text: str


class Line:
    """A line of words, held as columns; ``words`` are made when they are asked for."""

    def __init__(self, flow: int, block: int, words: list[Word]):
        self.flow, self.block = flow, block
        #: The line after it in the same layout block.
        self.next: Line | None = None
        self._columns = words if type(words) is tuple else tuple(zip(*words))
        x_min, y_min, x_max, y_max, self.sizes, spaces, _, self.bolds, self.fonts, self.texts = self._columns
        self.x_min, self.y_min, self.x_max, self.y_max = min(x_min), min(y_min), max(x_max), max(y_max)
        self.text = "".join([t + " " if space else t for t, space in zip(self.texts, spaces)])
        self.chars = len(self.text)
        #: Bytes of each word, and of the text with its blanks.
        self.bytes = list(map(len, self.texts)) if self.text.isascii() else list(map(size_of, self.texts))
        self.all_bytes = sum(self.bytes) + sum(map(bool, spaces))

    @cached_property
    def words(self) -> list[Word]:
        return list(map(Word._make, zip(*self._columns)))

    def heaviest(self, values: Sequence):
        """Of a value for each word the one with most bytes, the first seen on a tie."""
        if values.count(values[0]) == len(values):
            return values[0] if any(self.bytes) else 0
        weight: dict = {}
        for value, size in zip(values, self.bytes):
            weight[value] = weight.get(value, 0) + size
        best = max(weight, key=weight.get)
        return best if weight[best] else 0

    @property
    def upper(self) -> bool:
        if self.text.islower() or self.text.isupper():
            return self.text.isupper()
        upper, lower = sum(map(str.isupper, self.text)), sum(map(str.islower, self.text))
        return upper + lower > 0 and 100 * upper // (upper + lower) >= 90


@dataclass
class Page:
    width: float
    height: float
    lines: list[Line] = field(default_factory=list)

    @cached_property
    def blocks(self) -> list[LineBlock]:
        """Its typographic line blocks."""
        return line_blocks(self.lines)


@dataclass
class LineBlock:
    lines: list[Line]
    size: float
    font: int
    bold: bool
    upper: bool

    def __post_init__(self):
        first = self.lines[0]
        self.x_min, self.y_min, self.x_max, self.y_max, self.chars = first.x_min, first.y_min, first.x_max, first.y_max, first.chars

    def add(self, line: Line) -> None:
        """Extends the box; the typography stays that of the first line."""
        self.lines.append(line)
        self.x_min, self.y_min = min(self.x_min, line.x_min), min(self.y_min, line.y_min)
        self.x_max, self.y_max = max(self.x_max, line.x_max), max(self.y_max, line.y_max)
        self.chars += line.chars

    def text(self, start: int = 0, limit: int | None = None) -> str:
        """Lines from ``start``, a blank before each but the first of the block, as many whole
        words as stay below ``limit`` bytes."""
        out: list[str] = []
        size = 0
        for number, line in enumerate(self.lines[start:], start):
            out.append(" " * (number > 0))
            size += number > 0
            if limit is None or size + line.all_bytes < limit:
                out.append(line.text)
                size += line.all_bytes
                continue
            for w, bytes_ in zip(line.words, line.bytes):
                if size + bytes_ >= limit:
                    return "".join(out)
                out.append(w.text + " " * w.space)
                size += bytes_ + w.space
        return "".join(out)


def _number(value) -> float:
    """A number, also an integer; other kinds, and what is far beyond any page, count as 0."""
    if type(value) is float:
        return value
    return float(value) if type(value) is int and -1e15 < value < 1e15 else 0.0


def _whole(value) -> int:
    return value if type(value) is int and -1e15 < value < 1e15 else 0


def _items(value) -> list:
    return value if type(value) is list else []


def _part(value, i: int):
    return value[i] if type(value) is list and len(value) > i else None


def _word(value) -> Word:
    fields = _items(value)
    if len(fields) < 14:
        fields = fields + [None] * (14 - len(fields))
    x0, y0, x1, y1, size, space, baseline, _, _, bold, _, _, font, text = fields[:14]
    return Word(_number(x0), _number(y0), _number(x1), _number(y1), _number(size), bool(_whole(space)), _number(baseline), bool(_whole(bold)), _whole(font), text if type(text) is str else "")


#: The places of a word's fields in its array, and their kinds as they are usually sent.
_PLACES = {0: {float}, 1: {float}, 2: {float}, 3: {float}, 4: {float}, 5: {int}, 6: {float}, 9: {int}, 12: {int}, 13: {str}}


def _line(flow: int, block: int, values: list) -> Line:
    """A line of positional arrays. If all have the usual kinds their columns stay as they are."""
    if {*map(type, values)} == {list} and {*map(len, values)} == {14}:
        sent = tuple(zip(*values))
        if all({*map(type, sent[i])} == kind for i, kind in _PLACES.items()) and all(-1e15 < min(sent[i]) and max(sent[i]) < 1e15 for i in (5, 9, 12)):
            own = [sent[i] for i in _PLACES]
            own[5], own[7] = tuple(map(bool, own[5])), tuple(map(bool, own[7]))
            return Line(flow, block, tuple(own))
    return Line(flow, block, [_word(w) for w in values])


def parse_pages(pages: list, most: int = 5) -> list[Page]:
    """Positional arrays to pages; values of a wrong kind count as 0, lines without words are left out."""
    out = []
    for page in pages[:most]:
        own = Page(_number(_part(page, 0)), _number(_part(page, 1)))
        for f, flow in enumerate(_items(_part(page, 2))):
            for b, block in enumerate(_items(_part(flow, 0))):
                rows = [_line(f, b, words) for line in _items(_part(block, 4)) if (words := _items(_part(line, 0)))]
                for line, after in zip(rows, rows[1:]):
                    line.next = after
                own.lines += rows
        out.append(own)
    return out


def _one_font(line: Line) -> int | None:
    return line.fonts[0] if line.fonts.count(line.fonts[0]) == len(line.fonts) else None


def _continues(block: LineBlock, line: Line, size: float, font: int, upper: bool) -> bool:
    """Whether ``line`` belongs to the typographic block before it."""
    last, gap = block.lines[-1], line.y_min - block.y_max
    if line.next and abs(gap - (line.next.y_min - line.y_max)) > block.size / 3:
        return False
    if block.upper != upper:
        face = lambda w: (w.font, w.size, w.y_max - w.y_min)
        if gap >= block.size or not {face(w) for w in line.words} & {face(w) for w in last.words}:
            return False
    ours, theirs = _one_font(line), _one_font(last)
    if ours is None or theirs is None:
        if font != block.font and not (size == block.size and gap < block.size):
            return False
    elif ours != theirs:
        return False
    most = block.size if block.size <= 12 and not block.upper else 2.5 * block.size
    if line.bolds[0] != block.bold or abs(block.size - size) > 1 or gap >= most:
        return False
    near = lambda a, b: abs(a - b) < 2
    left, right = near(line.x_min, block.x_min), near(line.x_max, block.x_max)
    inside = (line.x_min >= block.x_min or left) and (line.x_max <= block.x_max or right)
    around = (line.x_min <= block.x_min or left) and (line.x_max >= block.x_max or right)
    return inside or around


def line_blocks(lines: Iterable[Line]) -> list[LineBlock]:
    """Lines in reading order, merged by typography across layout blocks. Lines after the one that
    opens the last possible block are left out, also those that would continue it."""
    out: list[LineBlock] = []
    for line in lines:
        if len(out) == MAX_BLOCKS:
            break
        size, font, upper = line.heaviest(line.sizes), line.heaviest(line.fonts), line.upper
        if out and _continues(out[-1], line, size, font, upper):
            out[-1].add(line)
        else:
            out.append(LineBlock([line], size, font, line.bolds[0], upper))
    return out


def characters(line: Line) -> list[tuple[str, Word]]:
    """Code points with their words; combining marks are composed with what they follow, or dropped."""
    out: list[tuple[str, Word]] = []
    for w in line.words:
        for c in w.text + " " * w.space:
            if out and unicodedata.category(c) == "Mn":
                if len(both := unicodedata.normalize("NFC", out[-1][0] + c)) == 1:
                    out[-1] = (both, out[-1][1])
            else:
                out.append((c, w))
    return out[:MAX_LINE_CHARS]


class _Names:
    """Names of the author being read, and the authors of the line that are complete."""

    def __init__(self, refs: set[int]):
        self.authors: list[tuple[str, ...]] = []
        self.names: list[str] = []
        self.current = ""
        self.refs = refs

    def separate(self) -> bool:
        """A blank or dot after a name: False if the author ends here."""
        low = self.current.lower()
        if low in DEGREES:
            self.names, self.current = [], ""
        elif low in CONJUNCTIONS or not self.current[0].isupper():
            self.current = ""
        else:
            self.names.append(self.current)
            self.current = ""
            return len(self.names) < 4
        return False

    def finish(self) -> bool:
        """Ends an author: False if what was read makes the rest of the line doubtful."""
        low = self.current.lower()
        if low in DEGREES:
            self.names, self.current = [], ""
        elif low in CONJUNCTIONS:
            self.current = ""
        names = tuple(self.names + [self.current] * bool(self.current))
        self.names, self.current = [], ""
        if not names or "".join(names).lower() in CONJUNCTIONS:
            return True
        if not 2 <= len(names) <= 4 or len(names[-1]) < 2:
            return False
        self.authors.append(names)
        return True


def authors_of_line(line: Line, refs: set[int] | None = None) -> list[tuple[str, ...]]:
    """Names of each author of a line. ``refs`` collects the positions of authors that a footnote
    mark follows; it is shared by the lines of a block."""
    read = _Names(refs if refs is not None else set())
    text = characters(line)
    home: Word | None = None
    goes_on = False
    for c, w in text:
        goes_on = False
        if c == "~":
            continue
        raised = home is not None and abs(w.size - home.size) > 1 and abs(w.baseline - home.baseline) > 1
        letter = c not in "æÆ" and is_alphabetic(c)
        if not read.current:
            if c in " .":
                continue
            if raised and home.size > 1:
                read.refs.add(len(read.authors))
            elif letter:
                read.current = c
                home = home if read.names else text[0][1]
                goes_on = True
        elif raised or c == "*":
            read.refs.add(len(read.authors))
        elif letter or c in HYPHENS:
            read.current += c
            goes_on = True
        elif c in " .":
            goes_on = read.separate()
        if not goes_on and not read.finish():
            return read.authors
    # A line that ends in skipped characters leaves its last author open; it does not count.
    if goes_on:
        read.finish()
    return read.authors


class Author(NamedTuple):
    names: tuple[str, ...]
    #: A footnote mark follows.
    marked: bool


def author_lines(block: LineBlock) -> list[list[Author]]:
    """Authors of each line of a block, up to the first line that has none."""
    refs: set[int] = set()
    out = []
    for line in block.lines:
        found = authors_of_line(line, refs)
        if not found:
            break
        out.append([Author(names, number in refs) for number, names in enumerate(found)])
    return out


def judged_authors(lines: Iterable[list[Author]], word_type: Callable[[str], int]) -> tuple[int, list[tuple[str, ...]]]:
    """Confidence (0 to 2) and authors of the lines of a block, by evidence about their names."""
    confidence, out = 0, []
    for authors in lines:
        for names, marked in authors:
            negative = sum(word_type(n) < 0 for n in names if len(n.encode()) > 1)
            if negative >= 2 or negative == len(names):
                return confidence, out
            level = 2 if not negative or marked else 0
            confidence = max(confidence, 1 if len(authors) == 1 else level)
            out.append(tuple(names))
    return confidence, out


class Head(NamedTuple):
    """A block that reads like a title. Each option is a place of authors, as two lists of blocks:
    that block and others in the same row, and that block and others of the same face. Numbers
    point into a list of blocks with authors."""

    text: str
    options: list[tuple[list[int], list[int]]]


def _author_places(blocks: list[LineBlock], i: int) -> list[int]:
    """Where the authors of the title at ``i`` may stand, the first choice first: in the next block,
    in the one after a subtitle, in the one before."""
    title, found = blocks[i], []
    if i + 1 < len(blocks) and title.y_max < blocks[i + 1].y_min:
        found.append(i + 1)
    if i + 2 < len(blocks):
        middle, below = blocks[i + 1], blocks[i + 2]
        fits = middle.chars < 300 and middle.y_min - title.y_max < 2 * (below.y_min - middle.y_max)
        if fits and title.size >= max(middle.size, below.size) and title.y_max < middle.y_min and middle.y_max < below.y_min:
            found.append(i + 2)
    if i > 0 and title.size >= blocks[i - 1].size and title.y_min > blocks[i - 1].y_max:
        found.append(i - 1)
    return found


def title_order(blocks: list[LineBlock], threshold: float) -> list[int]:
    """Blocks that read like a title: by font size, then the upper-case ones that stand apart."""

    def reads(block: LineBlock, least: int) -> bool:
        text = block.text(limit=JUDGED_BYTES)
        return least <= len(text.encode()) <= 400 and alphabetic_percent(text) >= 60

    by_size = sorted(range(len(blocks)), key=lambda i: -blocks[i].size)
    found = [i for i in by_size if blocks[i].size >= threshold and reads(blocks[i], 25)]
    return found + [i for i, b in enumerate(blocks) if b.upper and reads(b, 20) and separated(blocks, i)]


def heads_of(page: Page, evidence: list[list[list[Author]]]) -> list[Head]:
    """The titles of a page in order of choice, those near which a block may hold authors. Such blocks
    are appended to ``evidence``."""
    blocks = page.blocks
    lines: dict[int, list[list[Author]]] = {}
    numbers: dict[int, int] = {}

    def has_authors(i: int) -> bool:
        if i not in lines:
            lines[i] = author_lines(blocks[i])
        return bool(lines[i])

    def number(i: int) -> int:
        if i not in numbers:
            numbers[i] = len(evidence)
            evidence.append(lines[i])
        return numbers[i]

    def face(i: int) -> tuple[int, float]:
        line = blocks[i].lines[0]
        return line.fonts[0], line.sizes[0]

    def run(start: int, joins: Callable[[int], bool]) -> list[int]:
        """Blocks from ``start`` on that join it, up to one that has no authors."""
        found = []
        for i in range(start, len(blocks)):
            if joins(i):
                if not has_authors(i):
                    break
                found.append(number(i))
        return found

    out = []
    for i in title_order(blocks, font_threshold(page.lines)):
        places = [p for p in _author_places(blocks, i) if has_authors(p)]
        options = [(run(p, lambda j, p=p: abs(blocks[p].y_min - blocks[j].y_min) < 3), run(p, lambda j, p=p: face(j) == face(p))) for p in places]
        if options:
            out.append(Head(blocks[i].text(limit=TITLE_BYTES), options))
    return out


def _collected(evidence: list, numbers: Iterable[int], word_type: Callable[[str], int]) -> tuple[int, list]:
    count, out = 0, []
    for n in numbers:
        confidence, authors = judged_authors(evidence[n], word_type)
        if not confidence:
            break
        count += 1
        out += authors
    return count, out


def chosen_title(heads: Iterable[Head], evidence: list, word_type: Callable[[str], int]) -> tuple[str, list[tuple[str, ...]]] | None:
    """The first title that has authors: those of the option of highest confidence and of all blocks
    in the same row or of the same face, whichever are more."""
    for text, options in heads:
        best = max(options, key=lambda o: judged_authors(evidence[o[0][0]], word_type)[0], default=None)
        if best and judged_authors(evidence[best[0][0]], word_type)[0]:
            in_row, in_face = (_collected(evidence, numbers, word_type) for numbers in best)
            return text, in_row[1] if in_row[0] > in_face[0] else in_face[1]
    return None


def alphabetic_percent(text: str) -> int:
    return 100 * sum(c in " \u2010\u2011\u2012" or is_alphabetic(c) for c in text) // len(text) if text else 0


def font_threshold(lines: Iterable[Line], least: int = 500) -> int:
    weight: dict[int, int] = {}
    for line in lines:
        for size, bytes_ in zip(line.sizes, line.bytes):
            weight[int(size)] = weight.get(int(size), 0) + bytes_
    return 1 + max((s for s, n in weight.items() if n > least and s <= 999), default=0)


def separated(blocks: list[LineBlock], i: int) -> bool:
    before = i == 0 or blocks[i].y_min - blocks[i - 1].y_max >= max(blocks[i].size, blocks[i - 1].size)
    after = i + 1 == len(blocks) or blocks[i + 1].y_min - blocks[i].y_max >= max(blocks[i].size, blocks[i + 1].size)
    return before or after


def shadowed(blocks: list[LineBlock], i: int) -> bool:
    """One of the 1-4 blocks before (never the first) overlaps in x and is larger than the gap to it."""
    block = blocks[i]
    return any(b.x_min <= block.x_max and b.x_max >= block.x_min and b.size > block.y_min - b.y_max for b in blocks[max(1, i - 4) : i])


def title_candidates(pages: list[Page]) -> list[str]:
    """Normalised texts to look up, in scan order, the last hit counting: at most three pages and never
    the last one decoded; blocks of up to 7 lines, also without their first line, and two
    neighbours of up to 6 lines together that start in the top third."""
    out: list[str] = []
    for page in pages[: min(3, len(pages) - 1)]:
        blocks = page.blocks
        for i, block in enumerate(blocks):
            if len(out) > MOST_LOOKUPS:
                break
            if shadowed(blocks, i):
                continue
            texts = [block.text(m, LOOKUP_BYTES) for m in (0, 1) if 0 < len(block.lines) - m <= 7]
            if i + 1 < len(blocks) and block.y_min <= page.height / 3 and len(block.lines) + len(blocks[i + 1].lines) <= 6:
                first = block.text(0, LOOKUP_BYTES)
                texts.append(first + blocks[i + 1].text(0, LOOKUP_BYTES - len(first.encode())))
            out += [key for t in texts if 15 <= len((key := normalize_text(t)).encode()) <= 300]
    return out


def _ends_with_dot(text: str) -> bool:
    return text.rstrip(" \n\r").endswith(".")


_HEADING_LETTERS = {name[0].upper() for name, _ in STRUCTURED_HEADINGS}


def _simple_heading(text: str) -> int:
    for name in ("abstract", "summary"):
        if text[:1] == name[0].upper() and text[: len(name)].lower() == name:
            return len(name)
    return 0


def _structured_heading(text: str) -> int:
    if text[:1] not in _HEADING_LETTERS:
        return 0
    return next((kind for name, kind in STRUCTURED_HEADINGS if text[:1] == name[0].upper() and text[1 : len(name)].lower() == name[1:]), 0)


def simple_abstract(page: Page) -> str | None:
    """The text after a heading, up to the end of its paragraph, block or flow."""
    start = next((i for i, line in enumerate(page.lines) if _simple_heading(line.texts[0])), None)
    if start is None:
        return None
    heading = page.lines[start].words[0]
    skip = _simple_heading(heading.text)
    text, low, high = "", None, None
    lines = page.lines
    for i in range(start, len(lines)):
        line = lines[i]
        for w in line.words:
            own = w.text[skip:]
            skip = max(0, skip - len(w.text))
            if not text:
                own = own[next((k for k, c in enumerate(own) if c.isdecimal() or is_alphabetic(c)), len(own)) :]
            if own:
                low, high = min(w.x_min, low if low is not None else w.x_min), max(w.x_max, high if high is not None else w.x_max)
            if w.space and skip:
                skip -= 1
            elif text or own:
                own += " " * w.space
            text += own
        if not text:
            continue
        if _too_long(text):
            return None
        text = text[:-1] if text.endswith("-") else text + " "
        before = [x for x in lines[max(0, i - 2) : i] if (x.flow, x.block) == (line.flow, line.block)]
        after = lines[i + 1] if i + 1 < len(lines) else None
        paragraph = len(before) == 2 and abs(before[0].x_max - before[1].x_max) < 1 and line.x_max < before[1].x_max - 2
        block_ends = after is None or (after.flow, after.block) != (line.flow, line.block)
        flow_ends = after is None or after.flow != line.flow
        if flow_ends or (_ends_with_dot(text) and (paragraph or block_ends)):
            return text if low <= heading.x_max <= high else None
    return None


def _too_long(text: str) -> bool:
    return len(text.rstrip(" \n").encode()) >= ABSTRACT_BYTES


def structured_abstract(page: Page) -> str | None:
    """From the first heading to the end of its flow, if there are two headings, all headings align
    and a conclusion is last."""
    kinds, text, first = [], "", None
    for line in page.lines:
        if first and line.flow != first[1]:
            break
        if kind := _structured_heading(line.texts[0]):
            head = line.words[0]
            if first and (abs(head.x_min - first[0].x_min) > 2 or abs(head.size - first[0].size) > 1):
                return None
            text += "\n" * bool(text)
            kinds.append(kind)
            first = first or (head, line.flow)
        if kinds:
            text += line.text
    return text if len(kinds) >= 2 and kinds[-1] == 3 and not _too_long(text) else None


def abstract(pages: Iterable[Page]) -> str | None:
    """The first abstract found, without keywords; without a keyword list it must end with a stop."""
    for page in pages:
        found = structured_abstract(page) or simple_abstract(page)
        if found:
            text = found.rstrip(" \n\r")
            at = min((k for k in (text.find("Keywords:"), text.find("KEYWORDS:")) if k > 0), default=0)
            if at:
                return text[: at - 1] or None
            return text if text.endswith(".") else None
    return None


def jstor_text(page: Page, prefix: str) -> str | None:
    """Lines of the block that holds the stable URL, up to that line, each with a line feed."""
    for block in page.blocks:
        for k, line in enumerate(block.lines):
            if line.text.startswith(prefix):
                return "".join(x.text + "\n" for x in block.lines[: k + 1])
    return None


def document_text(pages: list[Page], total_pages: int, most: int = 9999) -> str:
    """Words with their blanks, a line feed after lines and blocks, whole words below ``most`` bytes."""
    n = len(pages) if total_pages > len(pages) else len(pages) - 1 if len(pages) > 2 else 2
    out, size = [], 0
    for page in pages[:n]:
        for line in page.lines:
            if size + line.all_bytes < most:  # all of its words fit
                out.append(line.text + ("\n" if line.next else "\n\n"))
                size += line.all_bytes + (1 if line.next else 2)
                continue
            for k, w in enumerate(line.words):
                ends = k + 1 == len(line.words)
                if size + line.bytes[k] >= most:
                    return "".join(out)
                out.append(w.text + " " * w.space + "\n" * ends + "\n" * (ends and line.next is None))
                size += size_of(out[-1])
    return "".join(out)


def _layout_blocks(page: Page) -> list[tuple[str, float, float, float, float]]:
    groups: dict = {}
    for line in page.lines:
        groups.setdefault((line.flow, line.block), []).append(line)
    return [("".join(f"\n{x.text}\n" for x in g), min(x.x_min for x in g), min(x.y_min for x in g), max(x.x_max for x in g), max(x.y_max for x in g)) for g in groups.values()]


def headfoot_text(pages: list[Page], most: int = 8192) -> str:
    """Texts of blocks that stand in about the same place one or two pages on."""
    own = [_layout_blocks(p) for p in pages]
    out = ""
    for p, page in enumerate(pages):
        later = {}
        for q in (p + 1, p + 2):
            for b in own[q] if q < len(pages) else ():
                later.setdefault(b[0], []).append(b)
        for text, x0, y0, x1, y1 in own[p]:
            if y0 < 15 or y1 > page.height - 15 or text in out or len((out + text).encode()) >= most:
                continue
            if any(max(abs(x0 - b[1]), abs(y0 - b[2]), abs((x1 - x0) - (b[3] - b[1])), abs((y1 - y0) - (b[4] - b[2]))) < 10 for b in later.get(text, ())):
                out += text
    return out


def first_page(pages: list[Page]) -> int:
    """Index of the first page of the article, past covers told by width or else by fonts."""
    w = [p.width for p in pages]
    n = len(w)
    if n == 2 and w[0] != w[1]:
        return 1
    if n == 3 and w[0] != w[1] == w[2]:
        return 1
    if n >= 4 and not (w[0] != w[1] != w[2]):
        steps = [i + 1 for i in range(n - 3) if w[i] != w[i + 1] == w[i + 2]]
        if steps:
            return steps[-1]
    fonts = [set().union(*(line.fonts for line in p.lines)) for p in pages]
    found = 0
    for i in range(n - 2):
        later = fonts[i + 1 :]
        if sum(len(fonts[i]) * len(x) for x in later) >= 2 and not any(fonts[i] & x for x in later):
            found = i + 1
    return found


def page_number(pages: list[Page], page_step: int = 2, value_step: int = 1) -> tuple[int, int] | None:
    """(page index, number) of the first page number that continues ``page_step`` pages on. Both
    stand in lines that lie in the top or bottom margin as a whole."""
    in_margin = lambda line, page: line.y_max < 100 or line.y_min > page.height - 100
    numeric = [[(line, w, int(w.text)) for line in p.lines if in_margin(line, p) for w in line.words if w.text.isascii() and w.text.isdigit() and len(w.text) < 18] for p in pages]
    for p in range(len(pages) - page_step):
        if not pages[p].lines:
            continue
        left, right = min(x.x_min for x in pages[p].lines), max(x.x_max for x in pages[p].lines)
        for _, w, value in numeric[p]:
            place = abs(w.x_min - left) < 5 or abs(w.x_max - right) < 5 or abs((w.x_min + w.x_max) / 2 - (right - left) / 2) < 5
            if value > 0 and place:
                if any(v == value + value_step and abs(u.y_min - w.y_min) < 1 and abs(u.x_min - w.x_min) < 15 for _, u, v in numeric[p + page_step]):
                    return p, value
    return None


def page_range(pages: list[Page], total_pages: int) -> tuple[int, str]:
    """Index of the first page, and first and last page number; without page numbers, or if they
    start at 1, the last one only."""
    start, number, last = first_page(pages), 1, total_pages
    if found := page_number(pages):
        page, number = found
        if number == 1:
            start = page
        elif number == 2 and page >= 1:
            start, number = page - 1, 1
        last = number + total_pages - start - 1
    return start, f"{number}-{last}" if number > 1 else str(last)
