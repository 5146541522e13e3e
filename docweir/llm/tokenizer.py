"""Loading public tokenizer files, and cutting texts into the pieces that a tokenizer never joins."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import regex
from tokenizers import Tokenizer

#: Fixed value: how a byte-level pre-tokenizer cuts by itself.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The normaliser and the parts of pre-tokenizers that plain texts are cut by here as the library does.
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BYTES, MATCHES = {"type": "ByteLevel", "add_prefix_space": False}, {"type": "Split", "behavior": "Removed", "invert": True}

#: Outside of these characters, versions of Unicode, white space and case rules may differ between libraries.
UNSURE = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-˿]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation or padding; one for each worker process."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@cache
def special_pattern(path: str) -> re.Pattern | None:
    """Matches the added tokens, which the library cuts out of a text before anything else."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} of {path} needs matching rules that are not supported")
    return re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None


def rules(path: str) -> tuple[str, bool]:
    """The file's own split pattern, and whether texts are lower-cased first; a file with other rules is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, lower = spec["pre_tokenizer"] or {}, spec["normalizer"]
    has = lambda part, want: all(part.get(k) == v for k, v in want.items())
    steps = pre.get("pretokenizers", [pre])
    by_bytes = has(steps[-1], BYTES)
    if by_bytes and lower is None and len(steps) == 1 and steps[0].get("use_regex", True):
        return BYTE_PATTERN, False
    if by_bytes and lower == LOWER and len(steps) == 2 and has(steps[0], MATCHES) and "Regex" in steps[0]["pattern"] and not steps[1].get("use_regex", True):
        return steps[0]["pattern"]["Regex"], True
    raise ValueError(f"{path} normalises or cuts texts by rules that are not supported")


def splitter(path: str) -> Callable[[str], list[str]]:
    """A function from a text to its normalised pre-tokens and added tokens, in order.

    Encoding each by itself and joining the ids gives what the library gives for
    the whole text. Plain Latin text is cut by the file's own pattern; any other
    text goes through the library's normaliser and pre-tokenizer.
    """
    tok, special = load(path), special_pattern(path)
    pattern, lower = rules(path)
    # a group would be returned in place of the match
    find = lambda text, p=regex.compile(pattern): [m[0] for m in p.finditer(text)] if p.groups else p.findall(text)
    pre, norm = tok.pre_tokenizer, tok.normalizer

    def plain(text: str) -> list[str]:
        if not UNSURE.search(text):
            return find(unicodedata.normalize("NFC", text).lower() if lower else text)
        text = norm.normalize_str(text) if lower else text
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    if special is None:
        return plain

    def cut(text: str) -> list[str]:
        if not special.search(text):
            return plain(text)
        out: list[str] = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else plain(part) if part else []
        return out

    return cut
