"""A tolerant reader of XML streams: what stands in damaged sitemaps and feeds, entry by entry.

Bytes are inflated (gzip of one or more members), decoded and cut into tokens as they come, so a document is never held as a
tree or as a list of its entries. Nothing is an error to the automaton: a bare ``&`` or ``<`` is text, an end tag that nothing
opened is passed over, one that skips open elements closes them, and what is open where the document breaks off counts as far
as it goes. Time is linear in the document.
"""

from __future__ import annotations

import codecs
import html
import re
import zlib
from collections.abc import Iterable, Iterator

CHUNK = 1 << 16
#: A tag that is still open after so many characters ends at its first ">", quoted or not.
MAX_TAG = 1 << 16

_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TAG = re.compile(r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"</?\s*([A-Za-z_][\w.:-]*)")
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_DECLARED = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._:-]+)[\"']")
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Elements nested deeper are read as if they stood at this depth.
MAX_DEPTH = 256
#: Constructs that hold no elements: how they begin and end.
_SPANS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">"))


class Damaged(ValueError):
    """A compressed document that cannot be inflated whole."""


def _members(body: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(body):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.unconsumed_tail
            if not piece:
                piece, at = body[at : at + CHUNK], at + CHUNK
            if not piece:
                raise Damaged("the gzip stream breaks off")
            try:
                yield member.decompress(piece, 16 * CHUNK)
            except zlib.error as e:
                raise Damaged(f"the gzip stream is damaged: {e}") from None
        at = min(at, len(body)) - len(member.unused_data)
        at = len(body) - len(body[at:].lstrip(b"\0"))  # a member may be padded


def inflated(body: bytes) -> Iterator[bytes]:
    """The document in pieces, inflated if it is gzip; ``Damaged`` before the first piece if that does not go to the end."""
    if body[:2] != b"\x1f\x8b":
        yield from (body[i : i + CHUNK] for i in range(0, len(body), CHUNK))
        return
    for _ in _members(body):
        pass
    yield from _members(body)


def decoded_text(pieces: Iterable[bytes]) -> Iterator[str]:
    """Text of pieces of a document: by its mark or declaration, else UTF-8; what cannot be read becomes U+FFFD."""
    decoder = None
    for piece in pieces:
        if decoder is None:
            named = _DECLARED.match(piece[:256])
            name = next((n for mark, n in _MARKS if piece.startswith(mark)), named[1].decode() if named else "utf-8")
            try:
                b"<".decode(name, "replace")  # raises where the name is of no codec, or of one that is none of texts
                decoder = codecs.getincrementaldecoder(name)("replace")
            except (LookupError, UnicodeError):
                decoder = codecs.getincrementaldecoder("utf-8")("replace")
        yield decoder.decode(piece)
    if decoder is not None:
        yield decoder.decode(b"", True)


def unescape(text: str) -> str:
    """Character references that end in a semicolon; any other ``&`` is itself."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def tokens(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """("text", unescaped or CDATA), ("start" or "empty", tag as written), ("end", tag as written)."""
    held, until, keep = "", "", False
    source = iter(pieces)
    done = False
    while not done:
        piece = next(source, None)
        done = piece is None
        held += piece or ""
        at = 0
        while at < len(held):
            if until:  # inside a span
                end = held.find(until, at)
                if end < 0 and not done:
                    safe = max(at, len(held) - len(until) + 1)
                    if keep:
                        yield "text", held[at:safe]
                    at = safe
                    break
                if keep:
                    yield "text", held[at : end if end >= 0 else len(held)]
                at, until = (end + len(until), "") if end >= 0 else (len(held), until)
                continue
            if held[at] != "<":
                end = held.find("<", at)
                if end < 0 and not done:
                    cut = held.rfind("&", max(at, len(held) - 40))  # a reference may go on in the next piece
                    end = cut if cut >= 0 else len(held)
                    if end > at:
                        yield "text", unescape(held[at:end])
                    at = end
                    break
                end = end if end >= 0 else len(held)
                yield "text", unescape(held[at:end])
                at = end
                continue
            rest = held[at : at + 9]
            if not done and len(rest) < 9 and ">" not in rest:
                break
            span = next(((a, b) for a, b in _SPANS if rest.startswith(a)), None)
            if span:
                keep, until = span[0] == "<![CDATA[", span[1]
                at += len(span[0])
                continue
            if not _NAME.match(rest):
                yield "text", "<"
                at += 1
                continue
            tag = _TAG.match(held, at)
            end = tag.end() if tag else -1
            if end < 0:
                if not done and len(held) - at < MAX_TAG:
                    break
                end = held.find(">", at) + 1
                if not end:
                    if done:
                        return  # breaks off inside a tag
                    yield "text", held[at:]
                    at = len(held)
                    continue
            whole = held[at:end]
            yield ("end" if whole[1] == "/" else "empty" if whole.endswith("/>") else "start"), whole
            at = end
        held = held[at:]


def name_of(tag: str) -> str:
    return _NAME.match(tag)[1]


def local(name: str) -> str:
    return name.rpartition(":")[2].lower()


def attributes(tag: str) -> dict[str, str]:
    """Attributes by lower-case local name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        out.setdefault(local(m[1]), unescape(m[2] or m[3] or m[4] or ""))
    return out


def records(pieces: Iterable[str], roots: dict[str, tuple[tuple[str, ...], str, frozenset[str]]]) -> Iterator[tuple[str, dict]]:
    """(root, record) of the items of a document, as they end.

    ``roots``: by the root's local name the elements between root and item, the item, and its fields, whose prefix is that of the
    root, or any where the name begins with "*". A record holds, by field, a list of (text, attributes) of the item's own children
    of that name. A field's start ends an open field, and an item's start an open item. A document with another root has no items.
    """
    stack: list[str] = []
    root = prefix = ""
    path: tuple[str, ...] = ()
    item, fields = "", frozenset()
    record: dict | None = None
    depth = 0
    field, parts, given = "", [], {}

    def close(to: int) -> Iterator[tuple[str, dict]]:
        """Close all elements from number ``to`` on."""
        nonlocal record, field
        if field and to <= depth + 1:
            record.setdefault(field, []).append(("".join(parts).strip(), given))
            field = ""
        if record is not None and to <= depth:
            yield root, record
            record = None
        del stack[to:]

    for kind, token in tokens(pieces):
        if kind == "text":
            if field and len(stack) == depth + 2:
                parts.append(token)
            continue
        name = name_of(token)
        own = local(name)
        if kind == "end":
            opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] == own), -1)
            if opened > 0 or opened == 0 and own == root:
                yield from close(opened)
            if not stack:
                return
            continue
        if not stack:
            root, prefix = own, "" if own == "rdf" else name.rpartition(":")[0]
            if root not in roots or kind == "empty":
                return
            path, item, fields = roots[root]
            depth = len(path) + 1
            stack.append(own)
            continue
        alike = name.rpartition(":")[0] == prefix
        is_field = alike and own in fields or "*" + own in fields
        if record is not None and alike and own == item and len(stack) > depth:
            yield from close(depth)
        elif field and is_field:
            yield from close(depth + 1)
        if len(stack) == depth and own == item and tuple(stack[1:]) == path:
            record = {}
        elif record is not None and len(stack) == depth + 1 and is_field:
            field, parts, given = own, [], attributes(token)
        if len(stack) < MAX_DEPTH:
            stack.append(own)
            if kind == "empty":
                yield from close(len(stack) - 1)
    yield from close(0)
