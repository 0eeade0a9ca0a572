"""License scans by ordered signature rules.

A rule is a regular expression with a label, a priority and literal keywords.
An Aho-Corasick automaton over all keywords reads a text once and opens the
gate of the rules whose keywords occur; only those expressions run. A detection
inside another is suppressed if that one's priority is higher or, at the same
priority, it is longer or its rule comes first. A longer detection of lower
priority does not suppress what it holds, and both stay.

Two kinds of rules: signatures of license texts, file notices and short names,
written one by one (``license_texts``); and names of licenses in five forms of
speech (tag, address, grant, title, bare name).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.license_texts import BODIES, NOTICES, SHORT

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Between the words of a name.
GAP = r"[\s,;:()\"'*/_-]+"


@dataclass(frozen=True)
class Family:
    """A license: its label, an expression for its name, keywords of which any match of the name holds one, its tag and its address."""

    label: str
    name: str
    keyword: str
    tag: str
    address: str = ""


def _words(text: str) -> str:
    return GAP.join(re.escape(w) for w in text.split())


def _versioned(label: str, name: str, keyword: str, tag: str, versions: str, address: str = "") -> list[Family]:
    """A family for each version of a license, and one for the name without a version."""
    out = [Family(label, name, keyword, tag + r"(?![\w.-])", address and re.escape(address))]
    for v in versions.split():
        number = re.escape(v) if "." in v and not v.endswith(".0") else re.escape(v.removesuffix(".0")) + r"(?:\.0)?"
        version = rf"{name}(?:{GAP}(?:version|v|ver\.?))?{GAP}?v?{number}(?![\d.]*\d)"
        out.append(Family(f"{label}-{v}", version, keyword, rf"{tag}-{re.escape(v)}(?:-only|-or-later)?", address and re.escape(address) + rf"[-/]?{number}"))
    return out


# License names, short identifiers and addresses, as their publishers give them.
def families() -> tuple[Family, ...]:
    licence = r"licen[cs]e"
    out: list[Family] = []
    out += _versioned("apache", rf"apache(?:{GAP}software)?{GAP}{licence}", "apache", "apache", "1.0 1.1 2.0", "apache.org/licenses/license")
    out += _versioned("gpl", rf"(?:gnu{GAP})?(?<!lesser )(?<!library )(?<!affero )general{GAP}public{GAP}{licence}", "general", "gpl", "1.0 2.0 3.0", "gnu.org/licenses/gpl")
    out += _versioned("lgpl", rf"(?:gnu{GAP})?(?:lesser|library){GAP}general{GAP}public{GAP}{licence}", "general", "lgpl", "2.0 2.1 3.0", "gnu.org/licenses/lgpl")
    out += _versioned("agpl", rf"(?:gnu{GAP})?affero{GAP}general{GAP}public{GAP}{licence}", "affero", "agpl", "1.0 3.0", "gnu.org/licenses/agpl")
    out += _versioned("gfdl", rf"(?:gnu{GAP})?free{GAP}documentation{GAP}{licence}", "documentation", "gfdl", "1.1 1.2 1.3", "gnu.org/licenses/fdl")
    out += _versioned("mpl", rf"mozilla{GAP}public{GAP}{licence}", "mozilla", "mpl", "1.0 1.1 2.0", "mozilla.org/mpl/")
    out += _versioned("epl", rf"eclipse{GAP}public{GAP}{licence}", "eclipse", "epl", "1.0 2.0", "eclipse.org/legal/epl")
    out += _versioned("cddl", rf"common{GAP}development{GAP}and{GAP}distribution{GAP}{licence}", "development", "cddl", "1.0 1.1")
    out += _versioned("cpl", rf"common{GAP}public{GAP}{licence}", "common", "cpl", "1.0")
    out += _versioned("eupl", rf"european{GAP}union{GAP}public{GAP}{licence}", "european", "eupl", "1.0 1.1 1.2")
    out += _versioned("artistic", rf"artistic{GAP}{licence}", "artistic", "artistic", "1.0 2.0")
    out += _versioned("ofl", rf"(?:sil{GAP})?open{GAP}font{GAP}{licence}", "font", "ofl", "1.0 1.1", "scripts.sil.org/ofl")
    out += _versioned("osl", rf"open{GAP}software{GAP}{licence}", "software", "osl", "1.0 2.0 2.1 3.0")
    out += _versioned("afl", rf"academic{GAP}free{GAP}{licence}", "academic", "afl", "1.1 2.0 2.1 3.0")
    out += _versioned("ms-pl", rf"microsoft{GAP}public{GAP}{licence}", "microsoft", "ms-pl", "")
    out += _versioned("boost", rf"boost{GAP}software{GAP}{licence}", "boost", "bsl", "1.0", "boost.org/license")
    out += _versioned("zpl", rf"zope{GAP}public{GAP}{licence}", "zope", "zpl", "1.1 2.0 2.1")
    out += _versioned("psf", rf"python{GAP}software{GAP}foundation{GAP}{licence}", "foundation", "psf", "2.0")
    out += _versioned("odbl", rf"open{GAP}(?:data{GAP}commons{GAP}open{GAP})?database{GAP}{licence}", "database", "odbl", "1.0", "opendatacommons.org/licenses/odbl/")
    cc = rf"(?:creative{GAP}commons|cc)"
    words = {"by": "attribution", "nc": "non-?commercial", "nd": "no-?deriv(?:ative)?s?(?:{GAP}works)?", "sa": "share-?alike"}
    for parts in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        long = GAP.join(words[p].replace("{GAP}", GAP) for p in parts.split("-"))
        short = "[ -]".join(parts.split("-"))
        name = rf"\b{cc}{GAP}(?:{short}|{long})(?![ -](?:sa|nc|nd)\b)(?:{GAP}(?:international|unported|generic|{licence}))?"
        out += _versioned(f"cc-{parts}", name, "creative|cc", f"cc-{parts}", "1.0 2.0 2.5 3.0 4.0", f"creativecommons.org/licenses/{parts}/")
    for label, name, keyword, tag, address in (
        ("mit", rf"\bmit{GAP}{licence}", "mit", "mit", "opensource.org/licenses/mit"),
        ("isc", rf"\bisc{GAP}{licence}", "isc", "isc", "opensource.org/licenses/isc"),
        ("bsd", rf"\bbsd(?:[ -]style)?{GAP}{licence}", "bsd", "bsd", "opensource.org/licenses/bsd-license"),
        ("bsd-2-clause", rf"(?:\bbsd{GAP}(?:2|two){GAP}clause|\b(?:2|two){GAP}clause{GAP}bsd|simplified{GAP}bsd)", "bsd", "bsd-2-clause", "opensource.org/licenses/bsd-2-clause"),
        ("bsd-3-clause", rf"(?:\bbsd{GAP}(?:3|three){GAP}clause|\b(?:3|three){GAP}clause{GAP}bsd|(?:new|modified|revised){GAP}bsd)", "bsd", "bsd-3-clause", "opensource.org/licenses/bsd-3-clause"),
        ("cc0-1.0", rf"\bcc0(?:{GAP}1\.0)?|creative{GAP}commons{GAP}zero", "cc0|creative", "cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
        ("unlicense", r"\bthe\s+unlicense\b", "unlicense", "unlicense", "unlicense.org"),
        ("wtfpl", r"\bwtfpl\b|do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+licen[cs]e", "wtfpl|fuck", "wtfpl", "wtfpl.net"),
        ("zlib", rf"\bzlib(?:/libpng)?{GAP}{licence}", "zlib", "zlib", "opensource.org/licenses/zlib"),
        ("postgresql", rf"postgresql{GAP}{licence}", "postgresql", "postgresql", "opensource.org/licenses/postgresql"),
        ("ncsa", rf"university{GAP}of{GAP}illinois/ncsa{GAP}open{GAP}source{GAP}{licence}", "ncsa", "ncsa", "opensource.org/licenses/ncsa"),
        ("x11", rf"\bx11{GAP}{licence}", "x11", "x11", ""),
        ("ruby", rf"\bruby{GAP}{licence}", "ruby", "ruby", ""),
        ("php", rf"\bphp{GAP}{licence}", "php", "php-3.01", "php.net/license"),
        ("vim", rf"\bvim{GAP}{licence}", "vim", "vim", ""),
        ("json", rf"\bjson{GAP}{licence}", "json", "json", "json.org/license"),
        ("beerware", rf"\bbeer-?ware{GAP}{licence}", "beer", "beerware", ""),
        ("public-domain", r"(?:dedicated|released|placed)\s+(?:in)?to\s+the\s+public\s+domain", "public", "", ""),
        ("proprietary", r"\ball\s+rights\s+reserved\b", "reserved", "", ""),
    ):
        out.append(Family(label, name, keyword, re.escape(tag), re.escape(address)))
    return tuple(out)


@dataclass(frozen=True)
class Rule:
    """``needs``: groups of keywords; any match holds a keyword of each. A group ``at`` of the pattern is what is detected, else all of the match."""

    order: int
    label: str
    form: str
    priority: int
    needs: tuple[tuple[str, ...], ...]
    pattern: str


# Forms of speech and kinds of signatures with their priorities, highest first.
PRIORITIES = {"tag": 100, "body": 95, "address": 90, "notice": 85, "grant": 80, "title": 60, "short": 50, "name": 40}
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|governed)\s+(?:under|by)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:gnu\s+)?"
#: A tag may follow others in an expression of the same line.
TAG = r"spdx-license-identifier[ \t]*:[ \t]*(?:\(*[\w.+:-]+\)*[ \t]+(?:or|and|with)[ \t]+)*\(*(?P<at>{tag})(?![\w-])"
#: Between the words of a signature.
WIDE, NARROW = r"[\s,;:.()\"'“”‘’`*#/_|>-]+", r"[\s-]+"


def _signature(phrase: str, gap: str) -> str:
    """The phrase with ``gap`` for each space that is not in a character class."""
    return re.sub(r"\[[^\]]*\]|\\.| ", lambda m: gap if m[0] == " " else m[0], phrase)


def _written(texts: str, gap: str) -> list[tuple[str, tuple, str]]:
    """(label, needs, pattern) of each line."""
    out = []
    for line in texts.strip().splitlines():
        label, keyword, phrase = line.split(" | ", 2)
        out.append((label, ((max(keyword.split(), key=len),),), _signature(phrase, gap)))
    return out


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority; those of one form keep their order, versions after the bare name."""
    made: dict[str, list] = {form: [] for form in PRIORITIES}
    for form, texts, gap in (("body", BODIES, WIDE), ("notice", NOTICES, WIDE), ("short", SHORT, NARROW)):
        made[form] = _written(texts, gap)
    for f in families():
        own = (tuple(f.keyword.split("|")),)
        if re.search(r"licen\[cs\]e(?!\w)", f.name) and not re.search(r"\)\?$|\|", f.name):
            own += (("licen",),)
        if f.tag:
            made["tag"].append((f.label, (("spdx-license-identifier",),), TAG.replace("{tag}", f.tag)))
        if f.address:
            made["address"].append((f.label, (("http", "www."), (f.address.split("\\.")[0].split(".")[0],)), rf"(?:https?://|www\.)(?:www\.)?{f.address}[\w./-]*"))
        made["grant"].append((f.label, (*own, ("under", "by")), rf"{GRANT}(?:{f.name})"))
        made["title"].append((f.label, own, rf"(?m)^[ \t#*/;-]*(?:the\s+)?(?:{f.name})[ \t]*(?:\(.{{0,20}}\))?[ \t]*$"))
        made["name"].append((f.label, own, rf"(?:{f.name})"))
    flat = [(label, form, PRIORITIES[form], needs, pattern) for form in PRIORITIES for label, needs, pattern in made[form]]
    return tuple(Rule(i, *m) for i, m in enumerate(dict.fromkeys(flat)))


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    rule: int


def suppressed(found: list[Detection]) -> list[Detection]:
    """The detections that no other one suppresses, in text order.

    Priorities are taken from the highest; of each, one sweep by start, longest
    first, keeps what ends after all kept before it, also of higher priorities.
    """
    kept: list[Detection] = []
    for priority in sorted({d.priority for d in found}, reverse=True):
        level = sorted((d for d in found if d.priority == priority), key=lambda d: (d.start, -d.end, d.rule))
        above, at, furthest = kept, 0, -1
        mine = []
        for d in level:
            while at < len(above) and above[at].start <= d.start:
                furthest = max(furthest, above[at].end)
                at += 1
            if d.end > furthest:
                mine.append(d)
                furthest = d.end
        kept = sorted(kept + mine, key=lambda d: (d.start, d.end))
    return kept


class Scanner:
    """The compiled rules behind their keyword gate."""

    def __init__(self) -> None:
        self.rules = [(r, re.compile(r.pattern)) for r in rules()]
        self.whole = ["at" not in p.groupindex for _, p in self.rules]
        self.gate = ahocorasick.Automaton()
        self.by_keyword: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            for k in r.needs[0]:
                self.by_keyword.setdefault(k, []).append(i)
        for k in {k for r, _ in self.rules for group in r.needs for k in group}:
            self.gate.add_word(k, k)
        self.gate.make_automaton()

    def open_rules(self, text: str) -> list[int]:
        """Rules of which the text holds a keyword of each group."""
        there = {k for _, k in self.gate.iter(text)}
        opened = {i for k in there & self.by_keyword.keys() for i in self.by_keyword[k]}
        return sorted(i for i in opened if all(not there.isdisjoint(group) for group in self.rules[i][0].needs))

    def detections(self, text: str, i: int) -> list[Detection]:
        """What one rule finds."""
        rule, pattern = self.rules[i]
        group = 0 if self.whole[i] else "at"
        return [Detection(m.start(group), m.end(group), rule.label, rule.priority, i) for m in pattern.finditer(text) if m.end(group) > m.start(group)]

    def scan(self, text: str) -> list[Detection]:
        """Kept detections in a text whose A-Z are lower case; offsets in code points."""
        found: list[Detection] = []
        for i in self.open_rules(text):
            found += self.detections(text, i)
        return suppressed(found) if found else found


#: A-Z to lower case, and every byte that no word holds to a space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PHRASES = {tuple(p.encode().split()): label for p, label in BASE_PHRASES.items()}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand consecutively."""
    out = []
    at = -1
    for _ in range(words.count(b"license")):
        at = words.index(b"license", at + 1)
        for phrase, label in _PHRASES.items():
            start = at - len(phrase) + 1
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                out.append((start, label))
    return sorted(out)


_scanner: list[Scanner] = []


def _scan(text: str | None, scanner: Scanner) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TO_WORDS).split()
    base = base_places(words)
    found = scanner.scan(raw.lower().decode("utf-8", "surrogatepass"))
    return {"n_words": len(words), "base": base, "found": found}


SCAN_SCHEMA = """doc_id long, n_words long, base array<struct<word:long,label:string>>,
detections array<struct<start:long,end:long,label:string,form:string,priority:int>>"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``base`` (places of base phrases) and ``detections`` (kept spans in code points) for every row of ``docs``.

    A null text counts as empty; null and repeated ids stay rows of their own.
    An empty table gives an empty result, and other columns are not looked at.
    Texts are scanned whole, in time linear in their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        scanner = _scanner[0]
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("form", pa.string()), ("priority", pa.int32())]))
        for batch in batches:
            rows = [_scan(t.as_py(), scanner) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r["n_words"] for r in rows], pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in r["base"]] for r in rows], base_type),
                    pa.array([[{"start": d.start, "end": d.end, "label": d.label, "form": scanner.rules[d.rule][0].form, "priority": d.priority} for d in r["found"]] for r in rows], span_type),
                ],
                names=["doc_id", "n_words", "base", "detections"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCAN_SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """One row of labels, places and score per scanned document.

    ``score`` is the highest priority kept, over 100; a base phrase counts as a
    bare name. Without any it is 0. Labels found more than once are named once,
    in order of the alphabet.
    """
    word = F.transform("base", lambda b: b["word"])
    base = F.transform("base", lambda b: b["label"])
    named = F.transform("detections", lambda d: d["label"])
    priority = F.array_max(F.concat(F.transform("detections", lambda d: d["priority"]), F.when(F.size("base") > 0, F.array(F.lit(40))).otherwise(F.array(F.lit(0)))))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, named))), ",").alias("labels"),
        (priority / 100).cast("double").alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
