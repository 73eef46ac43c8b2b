"""Raw e-mail to the texts that a reader sees: subject, text parts and text attachments, each on its own, transfer encodings undone.

Lenient throughout: messages may be cut, boundaries unclosed, charsets wrong, headers missing. A text without any header line is one plain part.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_PARAM = re.compile(r""";\s*([A-Za-z*0-9-]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;"]+))""")
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN_WORDS = re.compile(r"(\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?)")
_QP = re.compile(r"(?:=[0-9A-Fa-f]{2})+")
_QP_SOFT = re.compile(r"=[ \t]*\n")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
#: Elements that stand within a line; every other one ends a word.
_INLINE = "a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|head|title)\b.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>", re.DOTALL | re.IGNORECASE)
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: Characters without width, also where a wrong charset turned their bytes into three or two others.
_NO_WIDTH = re.compile(
    "[\xad\u0300-\u036f\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]"
    "|\xc2\xad|\xe2\u0080[\u008b-\u008f]|\xe2\u20ac[\u2039\u0152\u008d\u017d\u008f]|\xe2\u0081\xa0|\xef\xbb\xbf"
)
#: Initials before quote signs, however many, as in "> KO> ab> text".
_INITIALS = re.compile("^(?:[ \\t>|\u00bb]*[A-Za-z]{1,4}>)+", re.MULTILINE)


def _decode(raw: bytes, charset: str) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    for name in (charset, "cp1252"):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            pass
    return raw.decode("latin-1") if charset.lower().replace("_", "-") not in ("utf-8", "utf8") else raw.decode("utf-8", "replace")


def _from_base64(body: str) -> bytes:
    data = _NOT_BASE64.sub("", body)
    rest = len(data) % 4
    if rest == 1:
        data = data[:-1]
    elif rest:
        data += "=" * (4 - rest)
    try:
        return binascii.a2b_base64(data)
    except binascii.Error:
        return b""


def _from_quoted(body: str, charset: str) -> str:
    return _QP.sub(lambda m: _decode(bytes.fromhex(m[0].replace("=", "")), charset), _QP_SOFT.sub("", body))


def _encoded_word(m: re.Match) -> str:
    charset, kind, data = m[1].split("*")[0], m[2].lower(), m[3]
    if kind == "b":
        return _decode(_from_base64(data), charset)
    return _from_quoted(data.replace("_", " "), charset)


def _header_text(value: str) -> str:
    return _WORD.sub(_encoded_word, _BETWEEN_WORDS.sub(r"\1", value)) if "=?" in value else value


def _split(text: str) -> tuple[dict[str, str], str] | None:
    """Headers (first of each name, in lower case, unfolded) and body; None where the text doesn't begin with a header."""
    if not _HEADER.match(text):
        return None
    head, blank, body = text.partition("\n\n")
    headers: dict[str, str] = {}
    name = ""
    lines = head.split("\n")
    for i, line in enumerate(lines):
        if line[:1] in (" ", "\t"):
            if name:
                headers[name] += " " + line.strip()
            elif not line.strip():
                body = "\n".join(lines[i + 1 :]) + blank + body
                break
            continue
        m = _HEADER.match(line)
        if not m:
            if line.strip():  # the body begins without a blank line
                body = "\n".join(lines[i:]) + blank + body
                break
            continue
        name = m[0][:-1].strip().lower()
        if name in headers:
            name += "\0"
        headers[name] = line[m.end() :].strip()
    return headers, body


def from_html(text: str) -> str:
    text = _DROPPED.sub(" ", text)
    return html.unescape(_TAG.sub("\n", _INLINE_TAG.sub("", text)))


def _parts(body: str, mark: str) -> list[tuple[dict[str, str], str]] | None:
    """Headers and body of each part between boundary lines; None where no such line stands in the body."""
    pieces = re.split(rf"(?:^|\n)--{re.escape(mark)}(--)?[ \t]*(?=\n|\Z)", body)
    if len(pieces) == 1:
        return None
    out = []
    for i in range(2, len(pieces), 2):
        if pieces[i - 1]:  # after the closing mark
            break
        piece = pieces[i].removeprefix("\n")
        out.append(_split(piece) or ({}, piece.removeprefix("\n")))
    return out


def _message(text: str, out: list[str]) -> None:
    """The texts of a message in order, at any depth; ``todo`` holds messages (text) and parts (headers and body) that still wait."""
    todo: list[str | tuple[dict[str, str], str]] = [text]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            got = _split(now)
            if got is None:
                out.append(now)
                continue
            if got[0].get("subject"):
                out.append(_header_text(got[0]["subject"]))
            now = got
        headers, body = now
        kind = headers.get("content-type", "text/plain")
        main = kind.partition(";")[0].strip().lower() or "text/plain"
        params = {k.lower(): (a or b) for k, a, b in _PARAM.findall(kind)} if ";" in kind else {}
        if main.startswith("multipart/"):
            parts = _parts(body, params["boundary"]) if params.get("boundary") else None
            if parts is not None:
                todo += reversed(parts)
                continue
        elif main == "message/rfc822":
            todo.append(body.lstrip("\n"))
            continue
        elif not main.startswith("text/"):
            continue
        charset = params.get("charset", "utf-8") or "utf-8"
        how = headers.get("content-transfer-encoding", "").strip().lower()
        if how == "base64":
            body = _decode(_from_base64(body), charset)
        elif how == "quoted-printable":
            body = _from_quoted(body, charset)
        out.append(from_html(body) if main == "text/html" else body)


def readable(text: str) -> list[str]:
    """The texts of a message as a reader sees them, without quote signs and characters without width."""
    out: list[str] = []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("From ") and "\n" in text:
        text = text.partition("\n")[2]
    _message(text, out)
    for i, t in enumerate(out):
        if not t.isascii():
            t = _NO_WIDTH.sub("", t)
        if ">" in t:
            t = _INITIALS.sub("> ", t)
        out[i] = t
    return out
