"""Symbols, imports and chunks of source files: read off line tables in one Arrow UDF."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from functools import cached_property
from itertools import accumulate, takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column

from recollect.functions.slices import by_slices
from recollect.functions.text import SYMBOL_LANGUAGES, TEXT_LANGUAGES
from recollect.settings import CODE_CHUNK_FLOOR

# The patterns that define what counts as an import or a symbol.
IMPORTS = {
    "go": r'^\s*(?:import\s+(?:"([^"]+)"|\(\s*)|"([^"]+)")',
    "python": r"^\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import)",
    "ts": r"""^\s*import\s+(?:.*?\s+from\s+)?["']([^"']+)["']""",
}
SYMBOLS = {
    "go": (
        ("func", r"^func\s+(?:\([^)]*\)\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("type", r"^type\s+([A-Za-z_][A-Za-z0-9_]*)\s+(?:struct|interface|\(|=)"),
    ),
    "python": (
        ("func", r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("class", r"^class\s+([A-Za-z_][A-Za-z0-9_]*)\s*[\(:]"),
    ),
    "ts": (
        ("func", r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("class", r"^(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("func", r"^(?:export\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?"
                 r"(?:\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*=>"),
    ),
}
COMMENT = {"go": "//", "python": "#", "ts": "#"}
# What a line must hold, or begin with, to be worth matching; most lines hold neither.
IMPORT_MARK = {"go": '"', "python": "import", "ts": "import"}
SYMBOL_HEADS = {"go": ("func", "type"), "python": ("async", "def", "class"),
                "ts": ("export", "async", "function", "abstract", "class", "const")}
_IMPORTS = {lang: re.compile(p, re.A) for lang, p in IMPORTS.items()}
_SYMBOLS = {lang: [(k, re.compile(p, re.A)) for k, p in ps] for lang, ps in SYMBOLS.items()}


class Symbol(NamedTuple):
    name: str
    kind: str
    doc: str
    body: str
    first_line: int
    end_line: int


def language_of(path: str) -> str:
    """H23, for the Python side."""
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return SYMBOL_LANGUAGES.get(ext) or TEXT_LANGUAGES.get(ext, "")


class Outline:
    """Where the definitions of a source stand, read off tables made once for all lines: what a line
    defines, how far it is indented, and how many braces are open behind it."""

    def __init__(self, source: str, lang: str):
        self.lang, self.lines = lang, source.split("\n")
        self.bare = [line.strip() for line in self.lines]

    @cached_property
    def defined(self) -> list[tuple[str, str] | None]:
        return [self._definition(text) for text in self.bare]

    def _definition(self, text: str) -> tuple[str, str] | None:
        if not text.startswith(SYMBOL_HEADS.get(self.lang, ())):
            return None
        hits = ((kind, pattern.match(text)) for kind, pattern in _SYMBOLS.get(self.lang, ()))
        return next(((kind, hit[1]) for kind, hit in hits if hit), None)

    def imports(self) -> list[str]:
        pattern, mark = _IMPORTS.get(self.lang), IMPORT_MARK.get(self.lang)
        found = [pattern.match(line) for line in self.lines if mark in line] if pattern else []
        return [name for hit in found if hit for name in hit.groups() if name]

    @cached_property
    def _margins(self) -> list[int]:
        """Columns before the text, a tab counting four; blank lines have no margin to compare."""
        lead = [line[: len(line) - len(line.lstrip(" \t"))].replace("\t", " " * 4) for line in self.lines]
        return [len(x) if text else sys.maxsize for x, text in zip(lead, self.bare)]

    @cached_property
    def _open(self) -> list[int]:
        """Braces open behind each line, counted from the top of the file."""
        return list(accumulate(line.count("{") - line.count("}") for line in self.lines))

    def _end(self, first: int) -> int:
        """A Python body reaches to the next line, but one, that stands as far left as its head; others to the line
        that closes the first brace opened."""
        after = range(first, len(self.lines))
        if self.lang == "python":
            return next((i for i in after[2:] if self._margins[i] <= self._margins[first]), len(self.lines))
        level = self._open[first - 1] if first else 0
        opened = next((i for i in after if "{" in self.lines[i]), len(self.lines))
        return 1 + next((i for i in range(opened, len(self.lines)) if self._open[i] <= level), len(self.lines) - 1)

    def _comment_above(self, first: int, floor: int) -> str:
        """The comment lines above a head, as far as only comments and blank lines lie between."""
        marks = COMMENT[self.lang]
        above = takewhile(lambda text: not text or text.startswith(marks), reversed(self.bare[floor:first]))
        return "\n".join(reversed([text for text in above if text]))

    def symbols(self) -> list[Symbol]:
        """Definitions outside each other, in order."""
        return self._symbols

    @cached_property
    def _symbols(self) -> list[Symbol]:
        found: list[Symbol] = []
        for first, defined in enumerate(self.defined):
            floor = found[-1].end_line if found else 0
            if defined and first >= floor:
                end = self._end(first)
                found.append(Symbol(defined[1], defined[0], self._comment_above(first, floor),
                                    "\n".join(self.lines[first:end]), first, end))
        return found


def find_imports(source: str, lang: str) -> list[str]:
    return Outline(source, lang).imports()


def find_symbols(source: str, lang: str) -> list[Symbol]:
    return Outline(source, lang).symbols()


def overview(path: str, lang: str, imports: list[str], symbols: list[Symbol]) -> str:
    listed = "".join(f"- {s.kind} {s.name}\n" for s in symbols)
    named = f"Imports: {', '.join(imports)}\n" if imports else ""
    return f"File: {path} ({lang})\n{named}Symbols:\n{listed}"


def _runs(widths: list[int], next_stop) -> list[slice]:
    """Consecutive runs: `next_stop(ends, first, base)` says where the run that begins at `first` stops,
    given the running sums of the widths and the sum before it."""
    ends, runs, first = list(accumulate(widths)), [], 0
    while first < len(widths):
        stop = next_stop(ends, first, ends[first - 1] if first else 0)
        runs.append(slice(first, stop))
        first = stop
    return runs


def split_text(source: str, size: int = CODE_CHUNK_FLOOR) -> list[str]:
    """Pieces of whole lines, each up to `size` bytes where a line allows it; lossless."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", source)
    fits = lambda ends, first, base: max(first + 1, bisect_right(ends, base + size, first))
    return ["".join(lines[run]) for run in _runs([len(x.encode()) for x in lines], fits)]


def merged(texts: list[str], floor: int) -> list[slice]:
    """Runs of symbol texts that reach `floor` bytes. The text that reaches it belongs to the run, unless
    it overshoots a run that is half full without it."""
    def stop(ends: list[int], first: int, base: int) -> int:
        reaching = bisect_left(ends, base + floor, first)
        if reaching == len(ends):
            return reaching
        without = ends[reaching - 1] - base if reaching > first else 0
        overshoots = ends[reaching] - base > floor
        return reaching if without and without >= floor // 2 and overshoots else reaching + 1

    return _runs([len(t.encode()) for t in texts], stop)


def chunk_file(path: str, source: str, floor: int = CODE_CHUNK_FLOOR, outline: Outline | None = None) -> list[tuple[str, list[str], str]]:
    """(chunk type, entities, document): an overview and merged symbol chunks, or line
    pieces for files without symbols."""
    lang = language_of(path)
    outline = outline or Outline(source, lang)
    symbols = outline.symbols() if lang else []
    if symbols:
        texts = [f"{s.name} ({s.kind}):\n{s.doc + chr(10) if s.doc else ''}{s.body}\n\n" for s in symbols]
        return [("file_overview", [s.name for s in symbols], overview(path, lang, outline.imports(), symbols)),
                *(("symbol", [s.name for s in symbols[run]], "".join(texts[run])) for run in merged(texts, floor))]
    pieces = split_text(source, floor) if lang and source.strip() else []
    return [("text", [path.rsplit("/", 1)[-1]], piece) for piece in pieces]


PARSED = {"language": "string", "imports": "array<string>",
          "symbols": "array<struct<name:string,kind:string,doc:string,body:string,first_line:int,end_line:int>>",
          "chunks": "array<struct<chunk_type:string,entities:array<string>,document:string>>"}
SYMBOL_TYPES = dict(name=pa.string(), kind=pa.string(), doc=pa.string(), body=pa.string(), first_line=pa.int32(), end_line=pa.int32())


def _records(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Rows as a struct array, made column by column."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], names=list(kinds))


def _lists(rows: list[list], items) -> pa.Array:
    """A list array: `items` makes the array of all rows' items."""
    ends = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, items([x for row in rows for x in row]))


def parsed_code(path: Column, source: Column, parts: tuple[str, ...] = tuple(PARSED)) -> Column:
    """H24, H25 as a column: the `parts` asked for, no others are worked out."""
    names = lambda flat: pa.array(flat, pa.string())
    symbols = lambda flat: _records(flat, SYMBOL_TYPES)
    chunks = lambda flat: _records(flat, dict(chunk_type=pa.string(), entities=pa.list_(pa.string()), document=pa.string()))

    def parse(sources: pa.Array, paths: pa.Array) -> pa.Array:
        files = [(p, text, language_of(p)) for p, text in zip(paths.to_pylist(), sources.to_pylist())]
        outlines = [Outline(text, lang) for _, text, lang in files]
        make = {
            "language": lambda: names([lang for _, _, lang in files]),
            "imports": lambda: _lists([o.imports() for o in outlines], names),
            "symbols": lambda: _lists([o.symbols() for o in outlines], symbols),
            "chunks": lambda: _lists([chunk_file(p, text, outline=o) for (p, text, _), o in zip(files, outlines)], chunks)}
        return pa.StructArray.from_arrays([make[part]() for part in parts], names=list(parts))

    return by_slices(parse, f"struct<{','.join(f'{part}:{PARSED[part]}' for part in parts)}>", source, path, once=True)
