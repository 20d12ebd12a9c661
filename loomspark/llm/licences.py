"""Licence recognition by sentences: known sentences get identifiers, identifier sequences meet ordered rules.

A table maps the normalised sentences of public licence texts to identifiers, exactly; sentences with a place for a name,
and notices with a version, are patterns.  Rules are ordered sequences of identifiers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns
from .licence_texts import RULES, SHORT, SPDX, TEXTS

# What may stand in front of a licence's name: any subject, and the usual verbs.
_UNDER = r"(?!.*\b(?:not|never)\b)(?:.* )?(?:is |are |be )?(?:dual )?(?:licensed|released|distributed|available|published|provided|covered|used|copied) under (?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the |an? )?"
_VERSION = r",? ?(?:(?:version|v) ?)?(?P<name>{})(?: 0)?(?: only|,? or,? (?:at your option,? )?(?:any )?later(?: version)?)?(?: license)?(?: as published by the free software foundation)?"
_HEADER = r"(?:.* )?(?:redistribute it and or modify it|redistribute and or modify it|distributed and or modified|redistributed and or modified) under the terms of (?:version (?P<early>{1}) of )?the gnu {0} as published by the free software foundation(?:[,;]? (?:either )?version (?P<name>{1})(?: 0)?(?: of the license)?.*)?"

# Notices with a subject, a version or a holder in them, as patterns over normalised sentences (lower case,
# plain spaces).
NOTICES = [
    ("spdx", r"spdx license identifier (?P<name>[a-z0-9 +().,-]+)"),
    ("agpl-header", _HEADER.format("affero general public license", "3")),
    ("lgpl-header", _HEADER.format("(?:lesser|library) general public license", "2 1|2|3")),
    ("gpl-header", _HEADER.format("general public license", "[123]")),
    ("agpl-line", _UNDER + r"(?:gnu )?(?:affero general public license|agpl)(?: agpl)?" + _VERSION.format("3")),
    ("lgpl-line", _UNDER + r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: lgpl)?" + _VERSION.format("2 1|2|3")),
    ("gpl-line", _UNDER + r"(?:gnu )?(?:general public license|gpl)(?: gpl)?" + _VERSION.format("[123]")),
    ("apache-line", _UNDER + r"apache(?: software)?(?: license)?,? (?:(?:version|v) ?)?(?P<name>2 0)(?: license)?"),
    ("epl-line", r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?eclipse public license,? (?:version |v ?)?(?P<name>[12] 0)(?: which (?:accompanies this distribution|is available at).*)?"),
    ("epl-line", _UNDER + r"epl (?:version |v ?)?(?P<name>[12] 0)"),
    ("boost-line", r"(?:.* )?under the boost software license,? version 1 0.*"),
    ("zlib-line", _UNDER + r"zlib(?: libpng)? license"),
    ("unlicense-line", _UNDER + r"unlicense(?: license)?"),
    ("mpl-line", _UNDER + r"(?:mozilla public license|mpl)(?: mpl)?,? (?:version |v ?)?2 0"),
    ("isc-line", _UNDER + r"isc license"),
    ("bsd3-line", _UNDER + r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|bsd 3 clause new or revised)(?: license)?"),
    ("bsd2-line", _UNDER + r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?"),
    ("mit-line", _UNDER + r"mit(?: expat)?(?: open source)?(?: license)?"),
    ("cc-line", _UNDER + r"(?:cc|creative commons) (?P<name>by(?: nc)?(?: sa| nd)?(?: \d \d)?|zero|0)(?: license)?"),
    ("mpl-line", r"this source code form is subject to the terms of the mozilla public license,? v(?:ersion)? ?2 0"),
    ("copyright", r"(?:copyright|c) (?:c )?(?:19|20)\d\d(?:[ ,]+(?:19|20)\d\d)* .*"),
    ("copyright", r"copyright (?:c )?.*\b(?:19|20)\d\d\b"),
]
# The licence that a notice names; ``{}`` is the version or variant in it.
NOTICE_RULES = [
    ("AGPL-{}", ["agpl-header"]), ("AGPL-{}", ["agpl-line"]), ("LGPL-{}", ["lgpl-header"]), ("LGPL-{}", ["lgpl-line"]), ("GPL-{}", ["gpl-header"]), ("GPL-{}", ["gpl-line"]),
    ("EPL-{}", ["epl-line"]), ("BSL-1.0", ["boost-line"]), ("Zlib", ["zlib-line"]), ("Unlicense", ["unlicense-line"]), ("ISC", ["isc-line"]), ("MPL-2.0", ["mpl-line"]),
    ("BSD-3-Clause", ["bsd3-line"]), ("BSD-2-Clause", ["bsd2-line"]), ("Apache-{}", ["apache-line"]), ("MIT", ["mit-line"]), ("CC-{}", ["cc-line"]),
]
# Every known sentence holds one of these words, so a text without any has no known sentence.
WORDS = ("licen", "permi", "warrant", "redistribut", "copyright", "unencumbered", "under", "software", "loss of use", "advertising", "you just do", "prominent notices", "substitute goods", "source distribution", "mpl", "modified files", "derivative works")

_NOTICES = [(name, re.compile(pattern)) for name, pattern in NOTICES]
_BREAK = re.compile(r"[\n\r]+(?=\s*[\n\r])|(?<=[.;:])\s+|\n")
_NOT_WORD = re.compile(r"[^a-z0-9+,]+")
_BULLET = re.compile(r"^(?:[a-z0-9]|[ivx]+) (?=\S)")


def normalised(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip(" ,").replace(" ,", ",")


def sentences(text: str) -> list[tuple[int, str, str]]:
    """(place, normalised sentence, text): sentences end at line ends and behind ``. ; :``; a sentence of no known licence
    that a line end may have broken is tried again together with the next lines by ``recognise``."""
    return [(i, s, raw) for i, raw in enumerate(_BREAK.split(text)) if (s := normalised(raw))]


def _table() -> tuple[dict[str, str], list[tuple[str, re.Pattern]]]:
    """Identifiers by normalised sentence, and the patterns of sentences with a place for a name in them."""
    plain, slotted = {}, []
    rows = [(f"{name}/{i}", text) for name, texts in TEXTS.items() for i, text in enumerate(texts)]
    for own, text in [*rows, *((f"{name}/{i}", text) for name, i, text in SHORT)]:
        if "<x>" in text:
            parts = [re.escape(normalised(x)) for x in text.split("<x>")]
            slotted.append((own, re.compile(" ?(?:.{1,200}?) ?".join(parts))))
        else:
            plain.setdefault(normalised(text), own)
    return plain, slotted


_PLAIN, _SLOTTED = _table()
_CANONICAL = {name.lower(): name for name in SPDX}


def spdx(expression: str) -> list[str]:
    """Licences of an SPDX expression, in order, in canonical spelling: ``AND``, ``OR``, ``WITH`` and brackets fall away;
    an exception behind ``WITH`` is no licence; unknown names stay as they are written."""
    out, tokens, i = [], re.findall(r"[A-Za-z0-9.+-]+", expression), 0
    while i < len(tokens):
        word = tokens[i].rstrip(".")
        if word.upper() == "WITH":
            i += 2
            continue
        if word.upper() not in ("AND", "OR") and word:
            name = word.rstrip("+")
            out.append(_CANONICAL.get(name.lower(), name) + ("+" if word.endswith("+") else ""))
        elif not out:
            break
        elif i + 1 < len(tokens) and i and tokens[i - 1].upper() in ("AND", "OR"):
            break
        i += 1
        # a name that no operator joins to what stands before it is other text
        if i < len(tokens) and tokens[i].upper() not in ("AND", "OR", "WITH") and tokens[i - 1].upper() not in ("AND", "OR"):
            break
    return out


def _known(sentence: str) -> tuple[str, str] | None:
    """Identifier of a normalised sentence, and the name or version in it: an exact match first."""
    if own := _PLAIN.get(sentence) or _PLAIN.get(_BULLET.sub("", sentence)):
        return own, ""
    if not any(w in sentence for w in WORDS):
        return None
    for own, pattern in _SLOTTED:
        if pattern.fullmatch(sentence) or pattern.fullmatch(_BULLET.sub("", sentence)):
            return own, ""
    for name, pattern in _NOTICES:
        if m := pattern.fullmatch(sentence):
            own = m.groupdict().get("name") or m.groupdict().get("early") or ""
            return name, re.sub(r"(?<=\d) (?=\d)", ".", own).replace(" ", "-")
    return None


def match_rules(ids: list[str]) -> list[tuple[int, int, str]]:
    """(place, length, licence) of every rule in a sequence of identifiers, first place first.

    At a place the first rule of the list whose identifiers follow in order applies; identifiers of the same licence's
    text that no rule names may stand between them (``IGNORED``), others end it.
    """
    out, i = [], 0
    while i < len(ids):
        for licence, rule in _RULES:
            if ids[i] != rule[0]:
                continue
            at, k = i + 1, 1
            while k < len(rule) and at < len(ids):
                if ids[at] == rule[k]:
                    k += 1
                elif ids[at].split("/")[0] != rule[0].split("/")[0] and ids[at] != "copyright":
                    break
                at += 1
            if k == len(rule):
                while at < len(ids) and "/" in ids[at] and ids[at].split("/")[0] == rule[-1].split("/")[0] and ids[at] not in _HEADS:
                    at += 1  # the rest of the licence's own text
                out.append((i, at - i, licence))
                i = at
                break
        else:
            i += 1
    return out


_RULES = [*RULES, *NOTICE_RULES]
_HEADS = {rule[0] for _, rule in _RULES}


def recognise(text: str, joined: int = 12) -> tuple[list[str], list[str]]:
    """Sentence identifiers and licences of a text, in order.

    A sentence counts alone or, where it is broken over lines, joined with up to ``joined`` following parts.
    Identifiers that no rule takes name no licence.
    """
    low = text.lower()
    if not any(w in low for w in WORDS):
        return [], []
    parts, found, i = sentences(text), [], 0
    starts = [i for i, p in enumerate(parts) if _BEGINS.match(_BULLET.sub("", p[1])) or any(w in p[1] for w in WORDS)]
    near = set(starts)
    while i < len(parts):
        if i not in near:
            i += 1
            continue
        hit, used = None, 1
        for k in range(1, joined + 2):
            if i + k > len(parts):
                break
            # longer joins win only where they complete a sentence that its first line alone is not
            if k > 1 and _known(parts[i + k - 1][1]):
                break  # a known sentence of its own is no part of an unknown one
            whole = parts[i][1] if k == 1 else normalised(" ".join(p[2] for p in parts[i : i + k]))
            if k > 4 and not _BEGINS.match(_BULLET.sub("", whole)):
                break  # only sentences of the table are longer than a few lines
            if got := _known(whole):
                hit, used = got, k
                break
        if hit and hit[0].endswith("-header") and not hit[1]:  # the version may stand behind a semicolon or a line end
            for k in range(used + 1, min(used + 3, len(parts) - i) + 1):
                got = _known(normalised(" ".join(p[2] for p in parts[i : i + k])))
                if got and got[1]:
                    hit, used = got, k
                    break
        if hit:
            raw = " ".join(parts[j][2] for j in range(i, i + used))
            found.append((*hit, raw))
        i += used
    licences, ids = [], [name for name, _, _ in found]
    taken = {place: (length, licence) for place, length, licence in match_rules(ids)}
    for i, (name, own, raw) in enumerate(found):
        if name == "spdx":
            licences += spdx(re.split(r"(?i)identifier\s*:?", raw, maxsplit=1)[-1])
        elif i in taken:
            licences.append(taken[i][1].format(own.upper() if taken[i][1] == "CC-{}" else own).rstrip("-"))
    return ids, licences


#: First words of the table's sentences.
_BEGINS = re.compile("|".join(sorted({re.escape(" ".join(normalised(t.split("<x>")[0]).split()[:3])) for texts in TEXTS.values() for t in texts if normalised(t.split("<x>")[0])})))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, sentence_ids and licences (arrays in order of place), licensed.

    Null and empty texts have neither; a null ``doc_id`` stays null; repeated rows give repeated rows; an empty table
    gives none; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            found = [recognise(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([bool(f[1]) for f in found], pa.bool_())],
                names=["doc_id", "sentence_ids", "licences", "licensed"],
            )

    return doc_columns(docs).mapInArrow(run, "doc_id long, sentence_ids array<string>, licences array<string>, licensed boolean")
