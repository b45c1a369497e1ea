"""Operator 9: license scans by ordered signature rules.

A rule is a regex over a text's words, a keyword that the text must contain before the regex is tried, a priority and
a label. Detections are taken by priority, then length; one that lies within a detection already taken is suppressed.
What stays gives the labels and the score, the chance that at least one is right if each were right by its priority.

Base phrases are found apart from the rules and are never suppressed: their places and labels are exact.

Cases: null and empty texts have no words, places or labels and score 0; repeated rows give repeated results; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import share_package

#: The base phrases, as words, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Rules one by one: label; priority from 1 to 99; keyword; regex over words that stand one blank apart.
RULES = r"""
mit; 90; permission; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 85; mit; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
mit; 70; mit; mit licen[cs]e
mit; 60; expat; expat licen[cs]e
mit-0; 88; mit; mit no attribution(?: licen[cs]e)?
mit-0; 86; mit; mit 0(?: licen[cs]e)?
mit-cmu; 80; cmu; (?:mit cmu|cmu) licen[cs]e
mit-modern; 80; modern; mit licen[cs]e modern variant
isc; 90; isc; isc licen[cs]e
isc; 88; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd; 90; 0bsd; (?:0bsd|zero clause bsd)(?: licen[cs]e)?
0bsd; 89; zero; bsd zero clause licen[cs]e
bsd; 55; bsd; bsd licen[cs]e
bsd; 50; bsd; bsd style licen[cs]e
bsd-2-clause; 85; simplified; simplified bsd licen[cs]e
bsd-2-clause; 85; freebsd; freebsd licen[cs]e
bsd-3-clause; 85; revised; revised bsd licen[cs]e
bsd-3-clause; 85; bsd; new bsd licen[cs]e
bsd-3-clause; 92; endorse; neither the name of .{1,120} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause; 85; bsd; original bsd licen[cs]e
bsd-4-clause; 92; advertising; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd; 80; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause-clear; 88; clear; clear bsd licen[cs]e
apache; 55; apache; apache(?: software)? licen[cs]e
apache; 50; apache; apache style licen[cs]e
apache-2.0; 90; apache; www apache org licenses license 2 0
apache-2.0; 60; asl; asl 2 0
gpl; 45; gpl; (?:gnu )?gpl(?: licensed)?
gpl; 60; gnu; gnu general public licen[cs]e
gpl; 85; free; this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl; 80; gnu; www gnu org licenses gpl
gpl-2.0-or-later; 93; version; general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later; 93; version; general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-2.0-with-classpath-exception; 93; classpath; (?:gpl|general public licen[cs]e).{0,40} classpath exception
gpl-2.0-with-classpath-exception; 80; classpath; classpath exception
gpl-3.0-with-gcc-exception; 88; gcc; gcc runtime library exception
gpl-with-font-exception; 85; font; font exception
gpl-with-autoconf-exception; 85; autoconf; autoconf exception
gpl-with-bison-exception; 85; bison; bison exception
lgpl; 60; lesser; gnu lesser general public licen[cs]e
lgpl; 60; library; gnu library general public licen[cs]e
lgpl; 50; lgpl; (?:gnu )?lgpl
agpl; 60; affero; (?:gnu )?affero general public licen[cs]e
agpl; 50; agpl; (?:gnu )?agpl
gfdl; 65; documentation; gnu free documentation licen[cs]e
gfdl; 55; gfdl; gfdl
mpl; 55; mozilla; mozilla public licen[cs]e
mpl-2.0; 92; mozilla; this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0
mpl-2.0-no-copyleft-exception; 93; incompatible; incompatible with secondary licenses
epl; 55; eclipse; eclipse public licen[cs]e
edl-1.0; 85; eclipse; eclipse distribution licen[cs]e(?: v(?:ersion)? ?1 0)?
cddl; 60; cddl; cddl
cddl; 62; distribution; common development and distribution licen[cs]e
cpl-1.0; 75; common; common public licen[cs]e(?: version)?(?: 1 0)?
cpal-1.0; 85; attribution; common public attribution licen[cs]e
ipl-1.0; 85; ibm; ibm public licen[cs]e
eupl; 60; eupl; eupl
eupl; 62; european; european union public licen[cs]e
osl-3.0; 75; open; open software licen[cs]e(?: version)?(?: 3 0)?
afl-3.0; 75; academic; academic free licen[cs]e(?: version)?(?: 3 0)?
artistic; 60; artistic; artistic licen[cs]e
artistic-2.0; 85; artistic; artistic licen[cs]e (?:version )?2 0
artistic-1.0; 85; artistic; artistic licen[cs]e (?:version )?1 0
artistic-1.0-perl; 80; perl; same terms as perl itself
bsl-1.0; 90; boost; boost software licen[cs]e(?: version)?(?: 1 0)?
bsl-1.1; 88; business; business source licen[cs]e(?: version)?(?: 1 1)?
zlib; 85; zlib; zlib(?: libpng)? licen[cs]e
zlib; 90; warranty; provided as is without any express or implied warranty in no event will the authors be held liable
libpng; 80; libpng; libpng licen[cs]e
unlicense; 85; unlicense; (?:the )?unlicense
unlicense; 92; public; this is free and unencumbered software released into the public domain
wtfpl; 88; wtfpl; wtfpl
wtfpl; 90; want; do what the f\w* you want to public licen[cs]e
cc0-1.0; 90; cc0; cc0(?: 1 0)?(?: universal)?
cc0-1.0; 88; commons; creative commons zero(?: v?1 0)?(?: universal)?
cc0-1.0; 90; creativecommons; creativecommons org publicdomain zero 1 0
cc-pdm-1.0; 88; creativecommons; creativecommons org publicdomain mark 1 0
cc-pdm-1.0; 80; mark; public domain mark(?: 1 0)?
cc; 40; commons; creative commons(?: licen[cs]ed?| attribution)?
public-domain; 60; public; (?:released|placed|dedicated|given)? ?(?:in|into|to) the public domain
public-domain; 50; public; public domain dedication
psf-2.0; 80; python; python software foundation licen[cs]e
python-2.0; 75; python; python licen[cs]e(?: 2 0)?
php-3.01; 80; php; php licen[cs]e(?: version)?(?: 3 01)?
ruby; 75; ruby; ruby licen[cs]e
postgresql; 80; postgresql; postgresql licen[cs]e
openssl; 80; openssl; openssl licen[cs]e
ncsa; 80; illinois; university of illinois(?: ncsa)? open source licen[cs]e
w3c; 80; w3c; w3c(?: software)?(?: notice and)? licen[cs]e
unicode; 80; unicode; unicode (?:inc )?licen[cs]e(?: agreement)?
icu; 80; icu; icu licen[cs]e
ofl; 70; sil; sil open font licen[cs]e
ofl-1.1; 85; ofl; (?:sil )?ofl 1 1
ofl-1.1; 88; sil; sil open font licen[cs]e (?:version )?1 1
odbl-1.0; 85; database; open (?:data commons open )?database licen[cs]e
odbl-1.0; 80; odbl; odbl(?: 1 0)?
odc-by-1.0; 85; commons; open data commons attribution licen[cs]e
odc-by-1.0; 80; odc; odc by(?: 1 0)?
pddl-1.0; 85; dedication; (?:odc )?public domain dedication and licen[cs]e
pddl-1.0; 80; pddl; pddl(?: 1 0)?
cdla-permissive; 82; community; community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing; 82; community; community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?
ogl-uk; 82; government; open government licen[cs]e(?: v?[123](?: 0)?)?
etalab-2.0; 82; etalab; etalab(?: 2 0)?
etalab-2.0; 82; ouverte; licence ouverte(?: 2 0)?
bsd-protection; 82; protection; bsd protection licen[cs]e
ms-pl; 85; microsoft; microsoft public licen[cs]e
ms-pl; 75; ms; ms pl
ms-rl; 85; microsoft; microsoft reciprocal licen[cs]e
apsl-2.0; 80; apple; apple public source licen[cs]e(?: 2 0)?
npl-1.1; 80; netscape; netscape public licen[cs]e
sleepycat; 80; sleepycat; sleepycat licen[cs]e
qpl-1.0; 80; q; q public licen[cs]e
cecill; 80; cecill; cecill(?: [abc])?(?: v?[12](?: [01])?)?
mulan-psl; 82; mulan; mulan (?:permissive software licen[cs]e|psl)(?: v?[12])?
sspl-1.0; 88; server; server side public licen[cs]e
elastic-2.0; 88; elastic; elastic licen[cs]e(?: v?2(?: 0)?)?
commons-clause; 85; commons; commons clause
polyform; 80; polyform; polyform (?:noncommercial|small business|shield|perimeter|strict)(?: licen[cs]e)?
parity; 75; parity; parity public licen[cs]e
upl-1.0; 85; universal; universal permissive licen[cs]e
blueoak-1.0.0; 82; oak; blue oak model licen[cs]e
ecl-2.0; 82; educational; educational community licen[cs]e
vim; 75; vim; vim licen[cs]e
x11; 75; x11; x11 licen[cs]e
tcl; 75; tcl; tcl tk licen[cs]e
curl; 75; curl; curl licen[cs]e
json; 88; evil; the software shall be used for good not evil
beerware; 85; beer; beer ?ware licen[cs]e
openrail; 82; rail; (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?
llama; 80; llama; llama [23](?: [0-9])? community licen[cs]e(?: agreement)?
reserved; 40; rights; (?:all|some|no) rights reserved
proprietary; 60; proprietary; (?:confidential and proprietary|proprietary and confidential)
proprietary; 50; proprietary; proprietary licen[cs]e
proprietary; 65; prohibited; (?:unauthori[sz]ed|any) (?:copying|reproduction|distribution|use).{0,60} (?:is )?(?:strictly )?prohibited
proprietary; 55; commercial; commercial licen[cs]e
noncommercial; 45; commercial; non ?commercial use only
0bsd; 85; zero; (?:bsd zero clause|zero clause bsd|0bsd)(?: licen[cs]e)?
mit-0; 86; attribution; mit no attribution(?: licen[cs]e)?
mit-modern; 84; modern; modern mit licen[cs]e
bsd-patent; 86; patent; bsd(?: 2 clause)? plus patent licen[cs]e
bsd-attribution; 84; attribution; bsd with attribution
bsd-clear; 86; clear; clear bsd licen[cs]e
bsd-source-code; 84; bsd; bsd source code attribution
aladdin; 82; aladdin; aladdin free public licen[cs]e
adsl; 80; amazon; amazon digital services licen[cs]e
aal; 82; assurance; attribution assurance licen[cs]e
apl-1.0; 82; adaptive; adaptive public licen[cs]e(?: 1 0)?
bittorrent; 80; bittorrent; bittorrent open source licen[cs]e
catosl; 80; computer; computer associates trusted open source licen[cs]e
cern-ohl; 84; cern; cern open hardware licen[cs]e(?: version [12])?(?: (?:permissive|weakly reciprocal|strongly reciprocal))?
cnri; 80; cnri; cnri(?: python)?(?: open source)? licen[cs]e(?: agreement)?
condor; 78; condor; condor public licen[cs]e
cua-opl; 80; cua; cua office public licen[cs]e
d-fsl; 80; freie; deutsche freie software lizenz
eiffel; 78; eiffel; eiffel forum licen[cs]e(?: v?[12])?
entessa; 78; entessa; entessa public licen[cs]e
eudatagrid; 80; datagrid; eu datagrid software licen[cs]e
fair; 72; fair; fair licen[cs]e
frameworx; 78; frameworx; frameworx(?: open)? licen[cs]e
ftl; 82; freetype; freetype(?: project)? licen[cs]e
gsoap; 80; gsoap; gsoap public licen[cs]e
hpnd; 84; historical; historical permission notice and disclaimer
ijg; 82; jpeg; independent jpeg group(?: licen[cs]e)?
imagemagick; 80; imagemagick; imagemagick licen[cs]e
imatix; 78; imatix; imatix standard function library agreement
info-zip; 80; zip; info zip licen[cs]e
intel; 78; intel; intel open source licen[cs]e
interbase; 78; interbase; interbase public licen[cs]e
jasper; 76; jasper; jasper licen[cs]e
libtiff; 80; libtiff; libtiff licen[cs]e
liliq; 80; libre; licence libre du qu[^ ]+bec(?: (?:permissive|r[^ ]+ciprocit[^ ]+))?
lppl; 80; latex; latex project public licen[cs]e(?: v?1 [0123][abc]?)?
lpl; 78; lucent; lucent public licen[cs]e(?: v?1 0[012]?)?
miros; 78; miros; miros licen[cs]e
motosoto; 78; motosoto; motosoto(?: open source)? licen[cs]e
multics; 78; multics; multics licen[cs]e
nasa; 82; nasa; nasa open source agreement(?: 1 3)?
naumen; 78; naumen; naumen public licen[cs]e
nethack; 80; nethack; nethack general public licen[cs]e
nokia; 78; nokia; nokia open source licen[cs]e
nposl; 80; profit; non profit open software licen[cs]e(?: 3 0)?
ntp; 76; ntp; ntp licen[cs]e
oclc; 78; oclc; oclc research public licen[cs]e(?: 2 0)?
ogtsl; 80; group; open group test suite licen[cs]e
oset-pl; 80; oset; oset public licen[cs]e(?: version)?(?: 2 1)?
rpl; 80; reciprocal; reciprocal public licen[cs]e(?: 1 [15])?
rpsl; 80; realnetworks; realnetworks public source licen[cs]e
rscpl; 78; ricoh; ricoh source code public licen[cs]e
simpl; 78; simple; simple public licen[cs]e(?: 2 0)?
sissl; 80; sun; sun industry standards source licen[cs]e
spl-1.0; 80; sun; sun public licen[cs]e(?: v?1 0)?
sugarcrm; 78; sugarcrm; sugarcrm public licen[cs]e
tmate; 78; tmate; tmate open source licen[cs]e
torque; 78; torque; torque v?2 5 software licen[cs]e
vovida; 78; vovida; vovida software licen[cs]e
vsl; 76; vovida; vovida software licen[cs]e v?1 0
watcom; 80; watcom; sybase open watcom public licen[cs]e
wxwindows; 82; wxwindows; wxwindows library licen[cs]e(?: version)?(?: 3 1)?
xnet; 76; net; x net licen[cs]e
ypl; 78; yahoo; yahoo public licen[cs]e(?: v?1 [01])?
zend; 78; zend; zend licen[cs]e(?: v?2 0)?
zpl; 80; zope; zope public licen[cs]e(?: version)?(?: [12] [01])?
copyright; 20; copyright; copyright (?:c )?(?:19|20)[0-9]{2}
copyright; 15; copyright; copyright holders?
"""


def families() -> Iterator[tuple[str, int, str, str]]:
    """Rules that a family's parts and versions make."""
    said = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        short, full = kind.replace("-", " "), " ".join(said[p] for p in kind.split("-"))
        strength = 60 + 5 * kind.count("-")
        yield f"cc-{kind}", strength, "cc", f"cc {short}"
        yield f"cc-{kind}", strength, "commons", f"creative commons {full}"
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", " ")
            yield f"cc-{kind}-{version}", strength + 20, "cc", f"cc {short} v?{v}"
            yield f"cc-{kind}-{version}", strength + 20, "commons", f"creative commons {full} (?:licen[cs]e )?v?{v}(?: (?:international|generic|unported))?"
            yield f"cc-{kind}-{version}", strength + 21, "creativecommons", f"creativecommons org licenses {short} {v}"
    names = {"gpl": "(?:gnu )?general public licen[cs]e", "lgpl": "(?:gnu )?(?:lesser|library) general public licen[cs]e", "agpl": "(?:gnu )?affero general public licen[cs]e"}
    for label, name, versions in (("gpl", names["gpl"], ("1.0", "2.0", "3.0")), ("lgpl", names["lgpl"], ("2.0", "2.1", "3.0")), ("agpl", names["agpl"], ("1.0", "3.0"))):
        for version in versions:
            v = version.removesuffix(".0").replace(".", " ") + "(?: 0)?" * version.endswith(".0")
            later = "(?: of the licen[cs]e)?(?: or(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?| and later)"
            yield f"{label}-{version}", 75, "public", f"{name} (?:version |v)?{v}"
            yield f"{label}-{version}-or-later", 82, "public", f"{name} (?:version |v)?{v}{later}"
            yield f"{label}-{version}-only", 82, "public", f"{name} (?:version |v)?{v} only"
            yield f"{label}-{version}", 70, label, f"(?:gnu )?{label} ?v?(?:ersion )?{v}"
            yield f"{label}-{version}-or-later", 84, label, f"(?:gnu )?{label} ?v?(?:ersion )?{v}(?:{later}| plus)"
    versioned = [("apache", "apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")), ("epl", "eclipse public licen[cs]e", ("1.0", "2.0")), ("cddl", "common development and distribution licen[cs]e", ("1.0", "1.1")), ("eupl", "european union public licen[cs]e", ("1.0", "1.1", "1.2")), ("gfdl", "gnu free documentation licen[cs]e", ("1.1", "1.2", "1.3"))]
    for label, name, versions in versioned:
        for version in versions:
            v = version.replace(".", " ")
            yield f"{label}-{version}", 80, name.split("(")[0].split(" ")[0], f"{name}(?: version| v)? {v}"
            yield f"{label}-{version}", 72, label, f"{label}(?: version| v)? ?{v}"
    for count, said_count in ((1, "one"), (2, "two"), (3, "three"), (4, "four")):
        yield f"bsd-{count}-clause", 85, "clause", f"(?:bsd (?:{count}|{said_count}) clause|(?:{count}|{said_count}) clause bsd)(?: licen[cs]e)?"
    for tag in ("mit", "apache 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 2 0", "bsd 2 clause", "bsd 3 clause", "isc", "epl 2 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "unlicense", "zlib", "bsl 1 0"):
        label = re.sub(r"(\d) (\d)$", r"\1.\2", tag).replace(" ", "-")
        yield label, 97, "spdx", f"spdx licen[cs]e identifier {tag}"


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, int, bytes, re.Pattern]]:
    """All rules, in the order of their priority."""
    listed = [line.split("; ", 3) for line in RULES.strip().splitlines()]
    each = [(a, int(p), k, r) for a, p, k, r in listed] + list(families())
    return sorted(((a, p, k.encode(), re.compile(rf"(?<![^ ])(?:{r})(?![^ ])".encode())) for a, p, k, r in each), key=lambda x: (-x[1], x[0], x[3].pattern))


def mandatory(pattern: str) -> str:
    """What of a rule's pattern every match has: groups with a choice or without need are left out."""
    while (shorter := re.sub(r"\(\?:[^()]*\)\??", lambda m: " " if m[0].endswith("?") or "|" in m[0] else m[0][3:-1], pattern)) != pattern:
        pattern = shorter
    return pattern


@lru_cache(maxsize=1)
def by_need() -> tuple[list, list]:
    """Rules that need the word license in the text, beside their keyword, and the others."""
    named, others = [], []
    for rule in rules():
        (named if "licen" in mandatory(rule[3].pattern.decode().removeprefix("(?<![^ ])").removesuffix("(?![^ ])")) else others).append(rule)
    return named, others


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = rb"[^0-9a-z\x80-\xff]+"
BASE_PATTERNS = [(label, phrase.split(" ")[0].encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + GAP.join(phrase.encode().split(b" ")) + rb"(?![0-9a-z\x80-\xff])")) for phrase, label in BASE]
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_starts(low: bytes) -> np.ndarray:
    """Where each word begins."""
    inside = _INSIDE[np.frombuffer(low, np.uint8)]
    return np.flatnonzero(inside & ~np.r_[False, inside[:-1]])


def base_places(low: bytes, starts: np.ndarray) -> list[tuple[int, str]]:
    """(place of the first word, label) of every base phrase."""
    found = sorted((m.start(), label) for label, first, pattern in BASE_PATTERNS if first in low for m in pattern.finditer(low))
    places = np.searchsorted(starts, [at for at, _ in found]).tolist()
    return [(place, label) for place, (_, label) in zip(places, found, strict=True)]


Detection = tuple[int, int, int, str]


def detections(low: bytes) -> list[Detection]:
    """(priority, start, end, label) of the rules' detections that no other suppresses; places are of joined words."""
    named, others = by_need()
    live = [r for r in others if r[2] in low]
    if b"licen" in low:
        live += [r for r in named if r[2] in low]
    if not live:
        return []
    words = b" ".join(WORD.findall(low))
    return unsuppressed([(priority, m.start(), m.end(), label) for label, priority, _, pattern in live for m in pattern.finditer(words)])


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Detections by priority, then length, place and label, but for those inside one that was taken before them."""
    found = sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3]))
    kept: list[Detection] = []
    # Of the intervals taken, those that none contains: their starts and ends both rise.
    starts: list[int] = []
    ends: list[int] = []
    for d in found:
        at = bisect_right(starts, d[1])
        if at and ends[at - 1] >= d[2]:
            continue
        kept.append(d)
        low_at, high_at = bisect_left(starts, d[1]), bisect_right(ends, d[2])
        starts[low_at:high_at], ends[low_at:high_at] = [d[1]], [d[2]]
    return kept


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    share_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("text").cast(pa.binary()):
                low = raw.as_py().lower()
                starts = word_starts(low)
                base, more = base_places(low, starts), detections(low)
                own = {label for _, label in base}
                doubt = 1.0
                for d in more:
                    doubt *= 1 - d[0] / 100
                doubt *= 0.5 ** len(own)
                rows.append((len(starts), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {d[3] for d in more})), 1 - doubt))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
