"""Licence signatures for :mod:`jobscope.llm.license_scan` (fixed values).

Each line: label | kind | keyword | signature.  A signature is a regular expression in which one blank stands for any
white space and comment leaders; it is matched without regard to (ASCII) case.  The keyword is a lower-case string that
every text with a match contains: a rule is tried only on texts that hold it (white space and comment leaders, the
slash among them, count as one blank in both).  Kinds, in order of priority:

text    wording of the licence itself
notice  the notice that puts a work under the licence
name    its name or an address of it
mention a looser hint, suppressed inside anything better
"""

from __future__ import annotations

import re

SIGNATURES = r"""
mit|text|permission is hereby|permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files
mit|text|the above copyright notice and this permission|the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit|notice|mit license|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit license
mit|name|mit license|\bmit license\b
mit|name|mit licence|\bmit licence\b
mit|name|expat|\bexpat licen[sc]e\b
mit|name|opensource.org|opensource\.org/licenses?/mit\b
mit-0|name|mit no attribution|\bmit no attribution\b
mit-0|name|mit-0|\bmit-0\b
x11|name|x11|\bx11 licen[sc]e\b
apache-2.0|text|perpetual, worldwide|subject to the terms and conditions of this license,? each contributor hereby grants to you a perpetual, worldwide
apache-2.0|notice|apache license|licensed under the apache license,? version 2\.0
apache-2.0|notice|apache license|(?:released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache license,? version 2(?:\.0)?
apache-2.0|text|unless required by applicable law|unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an "as is" basis
apache-2.0|name|apache|\bapache(?: software)? license,? (?:version |v)?2(?:\.0)?\b
apache-2.0|name|apache.org|apache\.org/licenses/license-2\.0
apache-1.1|name|apache|\bapache(?: software)? license,? (?:version |v)?1\.1\b
apache-1.0|name|apache|\bapache(?: software)? license,? (?:version |v)?1\.0\b
apache|mention|apache|\bapache(?: software)? licen[sc]e\b
gpl-3.0|notice|general public license|(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license,? (?:version|v\.?) ?3
gpl-3.0|text|either version 3|either version 3 of the license,? or \(?at your option\)? any later version
gpl-3.0|name|general public license|\bgnu general public license,? (?:version |v\.? ?)3(?:\.0)?\b
gpl-3.0|name|gpl|\bgpl(?:-| )?v?3(?:\.0)?(?:-only|-or-later|\+)?\b
gpl-3.0|name|gnu.org|gnu\.org/licenses/gpl-3\.0
gpl-2.0|notice|general public license|(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license,? (?:version|v\.?) ?2
gpl-2.0|text|either version 2|either version 2 of the license,? or \(?at your option\)? any later version
gpl-2.0|name|general public license|\bgnu general public license,? (?:version |v\.? ?)2(?:\.0)?\b
gpl-2.0|name|gpl|\bgpl(?:-| )?v?2(?:\.0)?(?:-only|-or-later|\+)?\b
gpl-2.0|name|gnu.org|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-1.0|name|general public license|\bgnu general public license,? (?:version |v\.? ?)1(?:\.0)?\b
gpl|text|the gnu general public license|you should have received a copy of the gnu general public license along with this program
gpl|text|free software foundation|you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation
gpl|mention|general public license|\b(?:gnu )?general public license\b
gpl|mention|gpl|\bgnu gpl\b
lgpl-3.0|name|lesser general public license|\bgnu lesser general public license,? (?:version |v\.? ?)3(?:\.0)?\b
lgpl-3.0|name|lgpl|\blgpl(?:-| )?v?3(?:\.0)?(?:-only|-or-later|\+)?\b
lgpl-2.1|name|lesser general public license|\bgnu lesser general public license,? (?:version |v\.? ?)2\.1\b
lgpl-2.1|name|lgpl|\blgpl(?:-| )?v?2\.1(?:-only|-or-later|\+)?\b
lgpl-2.0|name|library general public license|\bgnu library general public license,? (?:version |v\.? ?)2(?:\.0)?\b
lgpl-2.0|name|lgpl|\blgpl(?:-| )?v?2(?:\.0)(?:-only|-or-later|\+)?\b
lgpl|name|lesser general public license|\b(?:gnu )?lesser general public license\b
lgpl|name|library general public license|\b(?:gnu )?library general public license\b
lgpl|mention|lgpl|\blgpl\b
agpl-3.0|name|affero general public license|\bgnu affero general public license,? (?:version |v\.? ?)3(?:\.0)?\b
agpl-3.0|name|agpl|\bagpl(?:-| )?v?3(?:\.0)?(?:-only|-or-later|\+)?\b
agpl|name|affero|\b(?:gnu )?affero general public license\b
agpl|mention|agpl|\bagpl\b
gfdl-1.3|name|free documentation license|\bgnu free documentation license,? (?:version |v\.? ?)1\.3\b
gfdl-1.2|name|free documentation license|\bgnu free documentation license,? (?:version |v\.? ?)1\.2\b
gfdl|name|free documentation license|\bgnu free documentation license\b
bsd-3-clause|text|endorse or promote|neither the names? of .{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software
bsd-3-clause|name|bsd|\b(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e\b
bsd-3-clause|name|bsd|\bbsd[- ]3(?:-| )clause\b
bsd-2-clause|text|redistributions of source code|redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer
bsd-2-clause|name|bsd|\b(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e\b
bsd-2-clause|name|bsd|\bbsd[- ]2(?:-| )clause\b
bsd-4-clause|text|all advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause|name|bsd|\b(?:original|old|4-clause|four-clause) bsd licen[sc]e\b
bsd-0-clause|name|0bsd|\b0bsd\b
bsd-0-clause|name|zero-clause|\bzero-clause bsd\b
bsd|notice|bsd|(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?bsd(?:-style)? licen[sc]e
bsd|mention|bsd|\bbsd(?:-style)? licen[sc]e\b
isc|text|permission to use|permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted
isc|name|isc licen|\bisc licen[sc]e\b
zlib|text|this software is provided 'as-is'|this software is provided 'as-is',? without any express or implied warranty
zlib|name|zlib|\bzlib(?:/libpng)? licen[sc]e\b
boost-1.0|text|boost software license|\bboost software license - version 1\.0
boost-1.0|name|boost|\bboost software license,? (?:version )?1\.0\b
boost|mention|boost software|\bboost software licen[sc]e\b
boost-1.0|name|bsl-1.0|\bbsl-1\.0\b
mpl-2.0|text|mozilla public|this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0
mpl-2.0|name|mozilla public license|\bmozilla public license,? (?:version |v\.? ?)?2(?:\.0)?\b
mpl-2.0|name|mpl-|\bmpl-v?2\.0\b
mpl-2.0|name|mozilla.org|mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1|name|mozilla public license|\bmozilla public license,? (?:version |v\.? ?)?1\.1\b
mpl-1.1|name|mpl-|\bmpl-v?1\.1\b
mpl-1.0|name|mozilla public license|\bmozilla public license,? (?:version |v\.? ?)?1\.0\b
mpl|mention|mozilla public|\bmozilla public licen[sc]e\b
epl-2.0|name|eclipse public license|\beclipse public license,? (?:-? ?)?(?:version |v\.? ?)?2(?:\.0)?\b
epl-2.0|name|epl-|\bepl-2\.0\b
epl-1.0|name|eclipse public license|\beclipse public license,? (?:-? ?)?(?:version |v\.? ?)?1(?:\.0)?\b
epl-1.0|name|epl-|\bepl-1\.0\b
epl|mention|eclipse public|\beclipse public licen[sc]e\b
edl-1.0|name|eclipse distribution|\beclipse distribution license\b
cddl-1.1|name|development and distribution|\bcommon development and distribution license,? (?:version |v\.? ?)?1\.1\b
cddl-1.0|name|development and distribution|\bcommon development and distribution license,? (?:version |v\.? ?)?1\.0\b
cddl|mention|development and distribution|\bcommon development and distribution licen[sc]e\b
cddl|mention|cddl|\bcddl\b
cpl-1.0|name|common public license|\bcommon public license\b
ibm-pl-1.0|name|ibm public license|\bibm public license\b
eupl-1.2|name|european union public|\beuropean union public licen[sc]e,? (?:version |v\.? ?)?1\.2\b
eupl-1.1|name|european union public|\beuropean union public licen[sc]e,? (?:version |v\.? ?)?1\.1\b
eupl|mention|european union public|\beuropean union public licen[sc]e\b
osl-3.0|name|open software license|\bopen software license,? (?:version |v\.? ?)?3\.0\b
osl|mention|open software license|\bopen software license\b
afl-3.0|name|academic free license|\bacademic free license,? (?:version |v\.? ?)?3\.0\b
afl|mention|academic free license|\bacademic free license\b
artistic-2.0|name|artistic license|\bartistic license,? (?:version |v\.? ?)?2(?:\.0)?\b
artistic-1.0|name|artistic license|\bartistic license,? (?:version |v\.? ?)?1(?:\.0)?\b
artistic|mention|artistic licen|\bartistic licen[sc]e\b
python-2.0|name|python software foundation|\bpython software foundation license(?:,? version 2)?\b
python|mention|python license|\bpython license\b
ruby|name|ruby license|\bruby license\b
php-3.01|name|php license|\bthe php license,? version 3\.01\b
php|mention|php license|\bphp license\b
postgresql|name|postgresql licen|\bpostgresql licen[sc]e\b
openssl|name|openssl license|\bopenssl license\b
openldap|name|openldap public|\bopenldap public license\b
ncsa|name|illinois/ncsa|\b(?:university of )?illinois/ncsa open source license\b
unlicense|text|free and unencumbered|this is free and unencumbered software released into the public domain
unlicense|name|unlicense|\bthe unlicense\b
wtfpl|name|wtfpl|\bwtfpl\b
wtfpl|name|do what the|\bdo what the f\S{1,12} you want to public license\b
beerware|name|beer|\bbeer-?ware license\b
sil-ofl-1.1|name|open font license|\b(?:sil )?open font license,? (?:version |v\.? ?)?1\.1\b
sil-ofl|mention|open font license|\b(?:sil )?open font license\b
ms-pl|name|microsoft public license|\bmicrosoft public license\b
ms-rl|name|microsoft reciprocal|\bmicrosoft reciprocal license\b
apsl-2.0|name|apple public source|\bapple public source license\b
qpl-1.0|name|q public license|\bq public license\b
vim|name|vim license|\bvim license\b
w3c|name|w3c software|\bw3c software (?:notice and )?license\b
unicode|name|unicode|\bunicode,? inc\.? license agreement\b
zpl-2.1|name|zope public|\bzope public license\b
sleepycat|name|sleepycat|\bsleepycat license\b
cecill-2.1|name|cecill|\bcecill(?:-2\.1| v?2\.1)?\b
blueoak-1.0.0|name|blue oak|\bblue oak model license\b
upl-1.0|name|universal permissive|\buniversal permissive license\b
bsl-1.1|name|business source license|\bbusiness source license\b
sspl-1.0|name|server side public|\bserver side public license\b
elastic-2.0|name|elastic license|\belastic license(?: 2\.0)?\b
commons-clause|name|commons clause|\bcommons clause\b
openrail|name|openrail|\b(?:bigscience |creativeml )?openrail(?:-m)?\b
llama|name|community license agreement|\bllama \d?(?:\.\d)? ?community license agreement\b
cc0-1.0|text|this deed has dedicated|\bthe person who associated a work with this deed has dedicated the work to the public domain\b
cc0-1.0|name|cc0|\bcc0(?:[- ]1\.0)?(?: universal)?\b
cc0-1.0|name|publicdomain/zero|creativecommons\.org/publicdomain/zero/1\.0
cc-pddc|name|publicdomain/mark|creativecommons\.org/publicdomain/mark/1\.0
cc-by-nc-nd|notice|by-nc-nd|licensed under (?:a )?(?:creative commons|cc)(?: |-)by-nc-nd(?: |-)?\d?(?:\.\d)?
cc-by-nc-sa|notice|by-nc-sa|licensed under (?:a )?(?:creative commons|cc)(?: |-)by-nc-sa(?: |-)?\d?(?:\.\d)?
cc-by-nc|notice|by-nc|licensed under (?:a )?(?:creative commons|cc)(?: |-)by-nc(?![\w-])(?: \d(?:\.\d)?)?
cc-by-sa|notice|by-sa|licensed under (?:a )?(?:creative commons|cc)(?: |-)by-sa(?: |-)?\d?(?:\.\d)?
cc-by-nd|notice|by-nd|licensed under (?:a )?(?:creative commons|cc)(?: |-)by-nd(?: |-)?\d?(?:\.\d)?
cc-by|notice|licensed under|licensed under (?:a )?(?:creative commons|cc)(?: |-)by(?![\w-])(?: \d(?:\.\d)?)?
cc-by-nc-nd|name|by-nc-nd|\bcc(?: |-)by-nc-nd(?:[ -]\d\.\d)?\b
cc-by-nc-sa|name|by-nc-sa|\bcc(?: |-)by-nc-sa(?:[ -]\d\.\d)?\b
cc-by-nc|name|by-nc|\bcc(?: |-)by-nc(?!-)(?:[ -]\d\.\d)?\b
cc-by-sa|name|by-sa|\bcc(?: |-)by-sa(?:[ -]\d\.\d)?\b
cc-by-nd|name|by-nd|\bcc(?: |-)by-nd(?:[ -]\d\.\d)?\b
cc-by|name|cc-by|\bcc-by(?!-)(?:[ -]\d\.\d)?\b
cc-by-nc-nd|name|creative commons|\bcreative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s\b
cc-by-nc-sa|name|creative commons|\bcreative commons attribution[- ]non-?commercial[- ]share-?alike\b
cc-by-nc|name|creative commons|\bcreative commons attribution[- ]non-?commercial\b
cc-by-sa|name|creative commons|\bcreative commons attribution[- ]share-?alike\b
cc-by-nd|name|creative commons|\bcreative commons attribution[- ]no-?deriv(?:ative)?s\b
cc-by|name|creative commons|\bcreative commons attribution\b
cc-by-nc-nd|name|licenses/by|creativecommons\.org/licenses/by-nc-nd/\d\.\d
cc-by-nc-sa|name|licenses/by|creativecommons\.org/licenses/by-nc-sa/\d\.\d
cc-by-nc|name|licenses/by|creativecommons\.org/licenses/by-nc/\d\.\d
cc-by-sa|name|licenses/by|creativecommons\.org/licenses/by-sa/\d\.\d
cc-by-nd|name|licenses/by|creativecommons\.org/licenses/by-nd/\d\.\d
cc-by|name|licenses/by|creativecommons\.org/licenses/by/\d\.\d
creative-commons|mention|creative commons|\bcreative commons\b
odbl-1.0|name|database license|\bopen (?:data commons )?database license\b
odc-by-1.0|name|open data commons|\bopen data commons attribution license\b
pddl-1.0|name|public domain dedication|\bpublic domain dedication and license\b
ogl-uk-3.0|name|open government licen|\bopen government licen[sc]e(?: v3\.0)?\b
public-domain|notice|public domain|(?:placed|released|dedicated|put) (?:in|into|to) the public domain
public-domain|mention|public domain|\bpublic domain\b
all-rights-reserved|notice|all rights reserved|\bcopyright (?:\(c\) |© )?(?:\d{4}(?:-\d{4})? )?[^\n]{0,80}?all rights reserved\b
all-rights-reserved|notice|all rights reserved|\ball rights reserved\b
copyright-notice|mention|copyright|\bcopyright (?:\(c\)|©|\d{4})
copyright-notice|mention|©|© ?\d{4}
proprietary|notice|proprietary and confidential|\bproprietary and confidential\b
proprietary|notice|copying of this file|\bunauthori[sz]ed copying of this file,? via any medium,? is strictly prohibited\b
proprietary|name|user licen|\bend[- ]user licen[sc]e agreement\b
proprietary|mention|proprietary licen|\bproprietary licen[sc]e\b
non-commercial|notice|non-commercial use only|\bfor non-commercial use only\b
non-commercial|notice|noncommercial|\bpolyform noncommercial license\b
no-redistribution|notice|may not be reproduced|\bmay not be reproduced,? (?:distributed|stored|copied)[^\n]{0,60} without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
disclaimer|mention|without warrant|\bwithout warrant(?:y|ies) (?:or conditions )?of any kind\b
disclaimer|mention|provided|\bprovided (?:[^\s/*#>]++ ){0,8}?"as is"
licensed|mention|licensed under|\blicensed under\b
licensed|mention|released under|\breleased under (?:the|a) [^\n]{1,40}? licen[sc]e\b
copyleft|mention|copyleft|\bcopyleft\b
"""

# Identifiers that the standard tag "SPDX-License-Identifier:" names.
SPDX_IDS = """
0BSD AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0
CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0
ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2-only GFDL-1.3-only GPL-1.0-only GPL-2.0-only
GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0
OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 TCL Unicode-DFS-2016
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""

KINDS = ["text", "notice", "name", "mention"]
# How sure a detection of each kind is.
CONFIDENCE = {"text": 1.0, "notice": 0.95, "name": 0.9, "mention": 0.4}
# Taken whole or not at all: what follows a blank never begins with one of these characters, so a banner of comment
# leaders is passed over once, however long it is.
BLANK = r"[\s/*#>]++"


def rules() -> list[dict]:
    """All rules in order: ``rule`` (its number), ``label, priority, keyword, pattern, confidence, stem``.

    The stem is a string without blanks that every text with a match holds: a first filter for whole tables.
    """
    lines = [x.split("|", 3) for x in SIGNATURES.strip().splitlines()]
    lines += [[i.lower(), "text", "spdx-license-identifier", r"spdx-license-identifier: ?" + i.replace(".", r"\.") + r"(?![\w.+-])"]
              for i in SPDX_IDS.split()]
    lines = [[label, kind, re.sub(BLANK, " ", keyword), pattern] for label, kind, keyword, pattern in lines]
    return [{"rule": n, "label": label, "priority": KINDS.index(kind), "keyword": keyword,
             "pattern": "(?i)" + _spaced(pattern), "confidence": CONFIDENCE[kind],
             "stem": "licen" if "licen" in pattern else max(keyword.split(), key=len)}
            for n, (label, kind, keyword, pattern) in enumerate(lines)]


def _spaced(signature: str) -> str:
    """The signature with every blank as white space and comment leaders."""
    for either in ("(?: |-)", "[ -]", "[- ]"):
        signature = signature.replace(either, "(?:\0|-)")
    return signature.replace(" ?", "(?:\0)?").replace(" ", "\0").replace("\0", BLANK)
