"""Copybook text to a tree of data items. Metadata only: it runs on the driver, on one small text."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

SUFFIXES = (".cpy", ".CPY", ".cob", ".COB", ".copy", "")
#: A picture is one token: it ends at white space, and a full stop or comma at its end belongs to the statement.
TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|==.*?==|[^\s,;.()]+(?:[.,](?=[^\s])[^\s,;.()]*)*|[().]", re.S)
PICTURE = re.compile(r"(PIC(?:TURE)?(?:\s+IS)?)\s+(\S+)", re.I)
USAGES = {"COMP": "COMP", "COMPUTATIONAL": "COMP", "BINARY": "BINARY", "PACKED-DECIMAL": "PACKED-DECIMAL", "DISPLAY": "DISPLAY", "DISPLAY-1": "DISPLAY-1", "NATIONAL": "NATIONAL", "INDEX": "INDEX", "POINTER": "POINTER"}
USAGES |= {f"{long}-{k}": f"COMP-{k}" for long in ("COMP", "COMPUTATIONAL") for k in range(1, 7)}


@dataclass
class Occurs:
    least: int
    most: int
    depending_on: str | None = None
    indexed_by: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)


@dataclass
class Item:
    """A data description entry. offset counts from the record's start; length is one element's for tables."""

    level: int
    name: str
    picture: str | None = None
    usage: str = "DISPLAY"
    redefines: str | None = None
    occurs: Occurs | None = None
    values: list[str] = field(default_factory=list)
    sign: str | None = None  # leading or trailing
    separate: bool = False
    sync: bool = False
    children: list[Item] = field(default_factory=list)
    conditions: list[Item] = field(default_factory=list)
    offset: int = 0
    length: int = 0

    @property
    def filler(self) -> bool:
        return self.name == "FILLER"

    @property
    def size(self) -> int:
        """Bytes with all elements."""
        return self.length * (self.occurs.most if self.occurs else 1)


# --- text -----------------------------------------------------------------------------------------------------------


def find_member(name: str, folders: Iterable[str]) -> str | None:
    """The first file of a copybook member."""
    return next((p for d in folders for s in SUFFIXES if os.path.isfile(p := os.path.join(d, name + s))), None)


def source_lines(text: str, free: bool = False) -> list[str]:
    """Statement text of each line: comments gone, continued literals joined."""
    if free:
        return [line.split("*>")[0].rstrip() for line in text.splitlines()]
    out: list[str] = []
    for line in text.splitlines():
        line = line.expandtabs()
        mark, body = line[6:7], line[7:72]
        if len(line) < 7 or mark in "*/":
            continue
        if mark == "-" and out:
            body = body.lstrip()
            out[-1] = out[-1].rstrip() + body[body[:1] in ("'", '"') :]
        else:
            out.append(body)
    return out


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = text.replace(old, new)
    return text


def directives(text: str, word: str) -> Iterator[tuple[int, int, list[str]]]:
    """Where each sentence that begins with a word starts and ends (its full stop included), and its tokens after the word."""
    start, held = 0, None
    for m in TOKEN.finditer(text):
        if held is None:
            if m.group().upper() == word:
                start, held = m.start(), []
        elif m.group() == ".":
            yield start, m.end(), held
            held = None
        else:
            held.append(m.group())


def _pairs(tokens: list[str]) -> list[tuple[str, str]]:
    """What stands on either side of each BY, where both are pseudo-text."""
    bare = lambda x: x.strip("=").strip()
    sides = zip(tokens, tokens[1:], tokens[2:])
    return [(bare(a), bare(b)) for a, by, b in sides if by.upper() == "BY" and a[:2] == b[:2] == "=="]


def preprocess(text: str, folders: Iterable[str] = (), free: bool = False, _open: tuple[str, ...] = ()) -> str:
    """Text with COPY members in place and REPLACE applied. A member that is missing, or that copies itself, leaves a remark."""
    folders = list(folders)
    body = "\n".join(source_lines(text, free))
    out, at = "", 0
    for start, end, tokens in directives(body, "COPY"):
        out, at = out + body[at:start] + _member(tokens, folders, free, _open), end
    body = out + body[at:]
    out, at, pairs = "", 0, []
    for start, end, tokens in directives(body, "REPLACE"):
        out, at, pairs = out + _replaced(body[at:start], pairs), end, _pairs(tokens)  # REPLACE OFF has none
    return out + _replaced(body[at:], pairs)


def _member(tokens: list[str], folders: list[str], free: bool, opened: tuple[str, ...]) -> str:
    """The text that a COPY sentence stands for."""
    name = literal(tokens[0]) if tokens else ""
    if name in opened:
        return f"*> COPY {name} CIRCULAR\n"
    path = find_member(name, folders)
    if path is None:
        return f"*> COPY {name} NOT FOUND\n"
    with open(path, encoding="utf-8", errors="replace") as f:
        return _replaced(preprocess(f.read(), folders, free, (*opened, name)), _pairs(tokens))


# --- statements -----------------------------------------------------------------------------------------------------


def statements(text: str) -> list[list[str]]:
    """Tokens of each sentence; pictures are single tokens."""
    text = re.sub(r"\*>.*", "", text)
    kept: list[str] = []

    def hold(m: re.Match) -> str:
        p = m[2]
        end = re.search(r"[.,;]*$", p).group()
        kept.append(p[: len(p) - len(end)] if end else p)
        return f"PIC \x00{len(kept) - 1}\x00{' . ' if '.' in end else ' '}"

    out: list[list[str]] = [[]]
    for t in TOKEN.findall(PICTURE.sub(hold, text)):
        if t == ".":
            out.append([])
        else:
            for x in [t[:-1], "."] if t.endswith(".") and t[0] not in "'\"" else [t]:
                out.append([]) if x == "." else out[-1].append(kept[int(x[1:-1])] if x[:1] == "\0" else x)
    return [s for s in out if s]


def literal(token: str) -> str:
    return token[1:-1].replace(token[0] * 2, token[0]) if token[:1] in ("'", '"') else token


def entry(tokens: list[str]) -> Item | None:
    """A data description sentence."""
    if not tokens or not tokens[0].isdigit():
        return None
    t = [x if x[:1] in ("'", '"') else x.upper() for x in tokens]
    named = len(t) > 1 and t[1] not in ("PIC", "USAGE", "REDEFINES", "OCCURS", "VALUE", "VALUES")
    item = Item(int(t[0]), t[1] if named else "FILLER")
    i = 2 if named else 1

    def skip(*words: str) -> None:
        nonlocal i
        while i < len(t) and t[i] in words:
            i += 1

    while i < len(t):
        w = t[i]
        i += 1
        if w == "PIC":
            item.picture = t[i].upper()
            i += 1
        elif w == "USAGE":
            skip("IS")
        elif w in USAGES:
            item.usage = USAGES[w]
        elif w == "REDEFINES":
            item.redefines = t[i]
            i += 1
        elif w == "OCCURS":
            least = most = int(t[i])
            i += 1
            if i < len(t) and t[i] == "TO":
                most, i = int(t[i + 1]), i + 2
            item.occurs = Occurs(least, most)
            skip("TIMES")
        elif w == "DEPENDING" and item.occurs:
            skip("ON")
            item.occurs.depending_on = t[i]
            i += 1
        elif w in ("ASCENDING", "DESCENDING") and item.occurs:
            skip("KEY", "IS")
            item.occurs.keys.append(t[i])
            i += 1
        elif w == "INDEXED" and item.occurs:
            skip("BY")
            while i < len(t) and t[i] not in USAGES and t[i] not in ("PIC", "VALUE", "DEPENDING", "ASCENDING", "DESCENDING", "SYNC"):
                item.occurs.indexed_by.append(t[i])
                i += 1
        elif w in ("VALUE", "VALUES"):
            skip("IS", "ARE")
            while i < len(t) and (item.level == 88 or not item.values):
                if t[i] in ("THRU", "THROUGH"):
                    i += 2  # of a range, the first value stays
                    continue
                item.values.append(literal(t[i]))
                i += 1
        elif w in ("LEADING", "TRAILING"):
            item.sign = w.lower()
        elif w == "SEPARATE":
            item.separate = True
            item.sign = item.sign or "trailing"
        elif w in ("SYNC", "SYNCHRONIZED"):
            item.sync = True
    return item


def parse(text: str, folders: Iterable[str] = (), free: bool = False) -> list[Item]:
    """The 01 and 77 items of a copybook, nested by level. Level 66 is left out; 88 belongs to the item before it."""
    roots: list[Item] = []
    stack: list[Item] = []
    last: Item | None = None
    for s in statements(preprocess(text, folders, free)):
        item = entry(s)
        if item is None or item.level == 66:
            continue
        if item.level == 88:
            if last is not None:
                last.conditions.append(item)
            continue
        if item.level == 77:
            stack = []
        while stack and stack[-1].level >= item.level:
            stack.pop()
        (stack[-1].children if stack else roots).append(item)
        stack.append(item)
        last = item
    return roots


# --- programs -------------------------------------------------------------------------------------------------------


SECTIONS = ("FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE")


def sections(body: str) -> list[tuple[str, str, list[str]]]:
    """(section, file, names of its 01 and 77 items) of the data division; file is the FD or SD they belong to, or empty."""
    out: list[tuple[str, str, list[str]]] = []
    section = ""
    for s in statements(re.split(r"PROCEDURE\s+DIVISION", body, flags=re.I)[0]):
        words = [w.upper() for w in s[:2]]
        if words[-1] == "SECTION":
            section = words[0] if words[0] in SECTIONS else ""
            if section and section != "FILE":
                out.append((section, "", []))
        elif words[0] in ("FD", "SD") and section == "FILE" and len(words) > 1:
            out.append((section, words[1], []))
        elif section and out and (item := entry(s)) and item.level in (1, 77):
            out[-1][2].append(item.name)
    return out


def program_facts(text: str, free: bool = False) -> dict[str, list]:
    """What a program's other divisions say: its name, files, record formats, SQL, calls, tested values, paragraphs."""
    body = "\n".join(source_lines(text, free))
    flat = re.sub(r"\s+", " ", body)
    sql = [re.sub(r"\s+", " ", x).strip() for x in re.findall(r"EXEC\s+SQL(.*?)END-EXEC", body, re.S | re.I)]
    selects = []
    for x in re.findall(r"\bSELECT\s+(?!.*?\bFROM\b)(.*?)\.(?=\s|$)", flat.split("PROCEDURE DIVISION")[0], re.I):
        clause = lambda p, x=x: (m[1] if (m := re.search(p + r"\s+(?:IS\s+)?([\w-]+)", x, re.I)) else None)
        selects.append({"name": x.split()[0], "assign": clause(r"ASSIGN\s+(?:TO\s+)?"), "organization": clause("ORGANIZATION"), "access": clause(r"ACCESS(?:\s+MODE)?"), "key": clause(r"(?<!ALTERNATE )RECORD\s+KEY"), "alternate": clause(r"ALTERNATE\s+RECORD\s+KEY"), "status": clause(r"FILE\s+STATUS|STATUS")})
    procedure = re.split(r"PROCEDURE\s+DIVISION", body, flags=re.I)[1:]
    return {
        "sha256": [hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()],
        "sections": sections(body),
        "program": re.findall(r"PROGRAM-ID\s*\.\s*([\w-]+)", flat, re.I),
        "files": selects,
        "decimal_comma": re.findall(r"DECIMAL-POINT\s+IS\s+COMMA", flat, re.I),
        "formats": re.findall(r"\b[FS]D\s+([\w-]+).*?RECORDING\s+MODE\s+(?:IS\s+)?(\w+)", flat, re.I),
        "sql": sql,
        "host_variables": sorted({v for x in sql for v in re.findall(r":([\w-]+)", x)}),
        "calls": re.findall(r"\bCALL\s+['\"]([^'\"]+)['\"]", flat, re.I),
        "tested": [(e, re.findall(r"\bWHEN\s+('[^']*'|\"[^\"]*\"|[\w-]+)", x, re.I)) for e, x in re.findall(r"\bEVALUATE\s+([\w-]+)(.*?)END-EVALUATE", flat, re.I)],
        "paragraphs": [p for x in procedure for p in re.findall(r"^ {0,3}([A-Z0-9][\w-]*)\s*\.\s*$", x, re.I | re.M)],
    }
