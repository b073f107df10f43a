"""Pictures, byte lengths and offsets."""

from __future__ import annotations

from dataclasses import dataclass

from copperleaf.functions.codecs import expand
from copperleaf.plans.copybook import Item


@dataclass(frozen=True)
class Picture:
    category: str
    digits: int = 0  # before the point
    decimals: int = 0
    signed: bool = False
    chars: int = 0  # characters on display, a separate sign aside


def analyse(picture: str | None) -> Picture:
    """Category, digits and display length. Scaling by P is refused: it would change every value."""
    p = expand(picture or "")
    if not p:
        return Picture("ALPHANUMERIC")
    letters, edited = set(p) & set("XA"), set(p) & set("Z*+-$B0.,/")
    if letters:
        category = "ALPHANUMERIC_EDITED" if set(p) & set("9Z*+-$B0.,") else "ALPHABETIC" if letters == {"A"} else "ALPHANUMERIC"
        return Picture(category, chars=len(p))
    if edited:
        return Picture("NUMERIC_EDITED", chars=len(p.replace("V", "")))
    if "P" in p:
        raise ValueError(f"picture {picture}: scaling by P is not supported")
    whole, _, part = p.partition("V")
    digits, decimals = whole.count("9"), part.count("9")
    if digits + decimals > 38:
        raise ValueError(f"picture {picture}: more than 38 digits")
    return Picture("NUMERIC", digits, decimals, p.startswith("S"), digits + decimals)


def byte_length(item: Item) -> int:
    """Bytes of one element of an elementary item."""
    p = analyse(item.picture)
    n = p.digits + p.decimals
    match item.usage:
        case "COMP-3" | "PACKED-DECIMAL":
            return (n + 2) // 2
        case "COMP-6":
            return (n + 1) // 2
        case "COMP" | "COMP-4" | "COMP-5" | "BINARY":
            return 2 if n <= 4 else 4 if n <= 9 else 8
        case "COMP-1" | "INDEX":
            return 4
        case "COMP-2" | "POINTER":
            return 8
    return p.chars + (1 if p.category == "NUMERIC" and item.separate else 0)


def lay_out(items: list[Item], offset: int = 0) -> int:
    """Sets offsets and lengths; returns the end. What redefines an item starts where that one does; SYNC pads before."""
    start, end = offset, offset
    at: dict[str, int] = {}
    for item in items:
        begin = at.get(item.redefines, end) if item.redefines else end
        if item.children:
            item.offset = begin
            item.length = lay_out(item.children, begin) - begin
        else:
            item.length = byte_length(item)
            if item.sync and item.usage in ("COMP", "COMP-4", "COMP-5", "BINARY", "COMP-1", "COMP-2", "INDEX"):
                step = min(item.length, 8)
                begin += -(begin - start) % step
            item.offset = begin
        at[item.name] = item.offset
        end = max(end, item.offset + item.size)
    return end


def record_length(root: Item) -> int:
    return lay_out([root])
