"""Signatures of licences, written by hand, for texts cut into lower-case words.

A rule is a line: label | priority | keyword | signature. The keyword is a word that every match holds. A signature is a regular
expression over words with one blank between them, so "2.0" is "2 0" and "BSD-3-Clause" is "bsd 3 clause". It matches whole
words. {v} stands for an optional "version" before a number, {w} for up to six words of any kind.

Priorities: 4 a sentence of the licence itself or an identifier, 3 a name with its version, 2 a name alone, 1 a hint.
Of equal rules the one that stands first goes before.
"""

from __future__ import annotations

import re
from typing import NamedTuple

RULES_TEXT = r"""
cc-by | 1 | cc | cc by
gpl | 1 | general | general public license
reserved | 1 | reserved | all rights reserved

agpl-3.0 | 4 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
apache-2.0 | 4 | spdx | spdx license identifier apache 2 0
bsd-2-clause | 4 | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | 4 | spdx | spdx license identifier bsd 3 clause
cc0-1.0 | 4 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | 4 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | 4 | spdx | spdx license identifier cc by sa 4 0
epl-2.0 | 4 | spdx | spdx license identifier epl 2 0
gpl-2.0 | 4 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 4 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
isc | 4 | spdx | spdx license identifier isc
lgpl-2.1 | 4 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 4 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
mit | 4 | spdx | spdx license identifier mit(?: 0)?
mpl-2.0 | 4 | spdx | spdx license identifier mpl 2 0
unlicense | 4 | spdx | spdx license identifier unlicense
zlib | 4 | spdx | spdx license identifier zlib
bsl-1.0 | 4 | spdx | spdx license identifier bsl 1 0
other-spdx | 2 | spdx | spdx license identifier [0-9a-z]+

mit | 4 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | noninfringement | merchantability fitness for a particular purpose and noninfringement
mit | 3 | mit | (?:licensed|released|distributed|available|published) under the(?: terms of the)? mit licen[cs]e
mit | 3 | mit | mit licen[cs]e mit
mit | 3 | mit | the mit licen[cs]e(?: mit)?
mit | 2 | mit | mit licen[cs]ed?
mit | 2 | mit | licen[cs]e mit
mit | 2 | expat | expat licen[cs]e
mit-0 | 3 | mit | mit no attribution
mit-0 | 3 | mit | mit 0
x11 | 3 | x11 | x11 licen[cs]e
x11 | 3 | consortium | x consortium licen[cs]e

apache-2.0 | 4 | apache | licensed under the apache licen[cs]e version 2 0 the licen[cs]e
apache-2.0 | 4 | apache | http(?:s)? www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 3 | apache | apache(?: software)? licen[cs]e{v}2(?: 0)?
apache-2.0 | 3 | apache | apache 2 0(?: licen[cs]e)?
apache-2.0 | 3 | apache2 | apache2(?: licen[cs]e)?
apache-2.0 | 3 | asl | asl{v}2(?: 0)?
apache-1.1 | 3 | apache | apache(?: software)? licen[cs]e{v}1 1
apache-1.0 | 3 | apache | apache(?: software)? licen[cs]e{v}1 0
apache | 2 | apache | apache(?: software)? licen[cs]ed?
apache | 2 | apache | under apache

gpl-3.0 | 4 | gnu | either version 3 of the(?: gnu general public)? licen[cs]e or at your option any later version{w} gnu
gpl-3.0 | 3 | gnu | gnu general public licen[cs]e{v}3(?: 0)?(?: only| or later| or any later version)?
gpl-3.0 | 3 | gnu | version 3(?: 0)? of the gnu general public licen[cs]e
gpl-3.0 | 3 | general | general public licen[cs]e{v}3(?: 0)?
gpl-3.0 | 3 | gpl | gpl{v}3(?: 0)?(?: only| or later)?
gpl-3.0 | 3 | gplv3 | (?:gnu )?gplv3(?: 0)?(?: or later)?
gpl-3.0 | 3 | gpl3 | (?:gnu )?gpl3
gpl-2.0 | 3 | gnu | gnu general public licen[cs]e{v}2(?: 0)?(?: only| or later| or any later version)?
gpl-2.0 | 3 | gnu | version 2(?: 0)? of the gnu general public licen[cs]e
gpl-2.0 | 3 | general | general public licen[cs]e{v}2(?: 0)?
gpl-2.0 | 3 | gpl | gpl{v}2(?: 0)?(?: only| or later)?
gpl-2.0 | 3 | gplv2 | (?:gnu )?gplv2(?: 0)?(?: or later)?
gpl-2.0 | 3 | gpl2 | (?:gnu )?gpl2
gpl-1.0 | 3 | gnu | gnu general public licen[cs]e{v}1(?: 0)?
gpl-1.0 | 3 | gpl | gpl{v}1(?: 0)?
gpl-classpath | 4 | classpath | classpath exception(?: 2 0)?
gpl | 2 | gnu | gnu general public licen[cs]e
gpl | 2 | gnu | gnu gpl
gpl | 2 | gpl | gpl licen[cs]ed?
gpl | 2 | gpl | under(?: the)? gpl
gpl | 1 | copyleft | copyleft

lgpl-3.0 | 3 | gnu | gnu lesser general public licen[cs]e{v}3(?: 0)?(?: only| or later)?
lgpl-3.0 | 3 | lesser | lesser general public licen[cs]e{v}3(?: 0)?
lgpl-3.0 | 3 | lgpl | lgpl{v}3(?: 0)?(?: only| or later)?
lgpl-3.0 | 3 | lgplv3 | lgplv3(?: 0)?
lgpl-2.1 | 3 | gnu | gnu lesser general public licen[cs]e{v}2 1(?: only| or later)?
lgpl-2.1 | 3 | lesser | lesser general public licen[cs]e{v}2 1
lgpl-2.1 | 3 | lgpl | lgpl{v}2 1(?: only| or later)?
lgpl-2.1 | 3 | lgplv2 | lgplv2 1
lgpl-2.0 | 3 | library | gnu library general public licen[cs]e{v}2(?: 0)?
lgpl-2.0 | 3 | lgpl | lgpl{v}2(?: 0)?
lgpl | 2 | library | (?:gnu )?library general public licen[cs]e
lgpl | 2 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | lgpl | (?:gnu )?lgpl(?: licen[cs]ed?)?

agpl-3.0 | 3 | affero | gnu affero general public licen[cs]e{v}3(?: 0)?(?: only| or later)?
agpl-3.0 | 3 | affero | affero general public licen[cs]e{v}3(?: 0)?
agpl-3.0 | 3 | agpl | (?:gnu )?agpl{v}3(?: 0)?(?: only| or later)?
agpl-3.0 | 3 | agplv3 | (?:gnu )?agplv3(?: 0)?
agpl-1.0 | 3 | affero | affero general public licen[cs]e{v}1(?: 0)?
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (?:gnu )?agpl(?: licen[cs]ed?)?

gfdl-1.3 | 3 | documentation | (?:gnu )?free documentation licen[cs]e{v}1 3
gfdl-1.2 | 3 | documentation | (?:gnu )?free documentation licen[cs]e{v}1 2
gfdl-1.1 | 3 | documentation | (?:gnu )?free documentation licen[cs]e{v}1 1
gfdl | 2 | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | 2 | gfdl | (?:gnu )?gfdl
gfdl | 4 | invariant | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts

bsd | 4 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 4 | endorse | be used to endorse or promote products derived from this software
bsd-4-clause | 4 | advertising | all advertising materials mentioning features or use of this software
bsd-2-clause | 3 | bsd | (?:the )?(?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause | 3 | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | 3 | simplified | simplified bsd(?: licen[cs]e)?
bsd-2-clause | 3 | freebsd | freebsd licen[cs]e
bsd-3-clause | 3 | bsd | (?:the )?(?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | (?:new|modified|revised) bsd(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | (?:the )?(?:4|four) clause bsd(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | bsd 4 clause(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | original bsd licen[cs]e
0bsd | 3 | 0bsd | 0bsd
0bsd | 3 | bsd | zero clause bsd(?: licen[cs]e)?
bsd | 2 | bsd | bsd(?: style| type)? licen[cs]ed?

isc | 4 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | isc | isc licen[cs]e
isc | 2 | isc | licen[cs]e isc
mpl-2.0 | 4 | mozilla | subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | 3 | mozilla | mozilla public licen[cs]e{v}2(?: 0)?
mpl-1.1 | 3 | mozilla | mozilla public licen[cs]e{v}1 1
mpl-1.0 | 3 | mozilla | mozilla public licen[cs]e{v}1 0
mpl-2.0 | 3 | mpl | mpl{v}2(?: 0)?
mpl-1.1 | 3 | mpl | mpl{v}1 1
mpl | 2 | mozilla | mozilla public licen[cs]e
epl-2.0 | 3 | eclipse | eclipse public licen[cs]e{v}2(?: 0)?
epl-1.0 | 3 | eclipse | eclipse public licen[cs]e{v}1(?: 0)?
epl-2.0 | 3 | epl | epl{v}2(?: 0)?
epl-1.0 | 3 | epl | epl{v}1(?: 0)?
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 3 | eclipse | eclipse distribution licen[cs]e(?:{v}1(?: 0)?)?
cddl-1.1 | 3 | cddl | cddl{v}1 1
cddl-1.0 | 3 | cddl | cddl{v}1(?: 0)?
cddl-1.0 | 3 | distribution | common development and distribution licen[cs]e{v}1 0
cddl | 2 | distribution | common development and distribution licen[cs]e
cddl | 2 | cddl | cddl(?: licen[cs]e)?
cpl-1.0 | 3 | common | common public licen[cs]e(?:{v}1 0)?
cpal-1.0 | 3 | attribution | common public attribution licen[cs]e(?:{v}1 0)?
eupl-1.2 | 3 | eupl | eupl{v}1 2
eupl-1.1 | 3 | eupl | eupl{v}1 1
eupl | 2 | european | european union public licen[cs]e
eupl-1.2 | 3 | european | european union public licen[cs]e{v}1 2
eupl-1.1 | 3 | european | european union public licen[cs]e{v}1 1
osl-3.0 | 3 | open | open software licen[cs]e{v}3(?: 0)?
osl | 2 | open | open software licen[cs]e
afl-3.0 | 3 | academic | academic free licen[cs]e{v}3(?: 0)?
afl-2.1 | 3 | academic | academic free licen[cs]e{v}2 1
afl | 2 | academic | academic free licen[cs]e
artistic-2.0 | 3 | artistic | artistic licen[cs]e{v}2(?: 0)?
artistic-1.0 | 3 | artistic | artistic licen[cs]e{v}1(?: 0)?
artistic | 2 | artistic | artistic licen[cs]e
perl | 3 | perl | under the same terms as perl(?: itself)?
bsl-1.0 | 3 | boost | boost software licen[cs]e(?:{v}1(?: 0)?)?
bsl-1.0 | 2 | boost | boost licen[cs]e
zlib | 4 | altered | altered source versions must be plainly marked as such
zlib | 3 | zlib | zlib(?: libpng)? licen[cs]e
libpng | 3 | libpng | (?:the )?libpng licen[cs]e
unlicense | 4 | unencumbered | free and unencumbered software released into the public domain
unlicense | 3 | unlicense | (?:the )?unlicense
wtfpl | 3 | wtfpl | wtfpl
wtfpl | 4 | fuck | do what the fuck you want to(?: public licen[cs]e)?
postgresql | 3 | postgresql | postgresql licen[cs]e
python-2.0 | 3 | python | python software foundation licen[cs]e(?:{v}2(?: 0)?)?
python-2.0 | 3 | psf | psf licen[cs]e(?: agreement)?
php-3.01 | 3 | php | php licen[cs]e{v}3 01
php-3.0 | 3 | php | php licen[cs]e{v}3 0
php | 2 | php | php licen[cs]e
ruby | 3 | ruby | ruby licen[cs]e
w3c | 3 | w3c | w3c software(?: and document)?(?: notice and)? licen[cs]e
openssl | 3 | openssl | openssl licen[cs]e
ncsa | 3 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
vim | 3 | vim | vim licen[cs]e
tcl | 3 | tcl | tcl tk licen[cs]e
curl | 3 | curl | curl licen[cs]e
intel | 3 | intel | intel open source licen[cs]e
ms-pl | 3 | microsoft | microsoft public licen[cs]e(?: ms pl)?
ms-pl | 3 | ms | ms pl
ms-rl | 3 | microsoft | microsoft reciprocal licen[cs]e(?: ms rl)?
ms-rl | 3 | ms | ms rl
apsl-2.0 | 3 | apple | apple public source licen[cs]e(?:{v}2(?: 0)?)?
ofl-1.1 | 3 | sil | sil open font licen[cs]e(?:{v}1 1)?
ofl-1.1 | 3 | ofl | ofl 1 1
ofl-1.1 | 2 | font | open font licen[cs]e
ipl-1.0 | 3 | ibm | ibm public licen[cs]e(?:{v}1 0)?
qpl-1.0 | 3 | q | q public licen[cs]e(?:{v}1 0)?
sleepycat | 3 | sleepycat | sleepycat licen[cs]e
lppl-1.3c | 3 | lppl | lppl{v}1 3c?
lppl | 2 | latex | latex project public licen[cs]e
ecl-2.0 | 3 | educational | educational community licen[cs]e(?:{v}2(?: 0)?)?
upl-1.0 | 3 | universal | universal permissive licen[cs]e(?:{v}1(?: 0)?)?
mulan-2.0 | 3 | mulan | mulan(?: permissive software licen[cs]e| psl){v}2(?: 0)?
cecill | 3 | cecill | cecill(?: [bc])?(?:{v}[12](?: [01])?)?
blueoak-1.0.0 | 3 | oak | blue oak model licen[cs]e(?:{v}1 0 0)?
hippocratic | 3 | hippocratic | hippocratic licen[cs]e(?:{v}[123](?: [01])?)?
json | 3 | json | json licen[cs]e
json | 4 | evil | shall be used for good not evil
beerware | 3 | beerware | beerware(?: licen[cs]e)?
beerware | 3 | beer | beer ware licen[cs]e
sspl-1.0 | 3 | sspl | sspl(?:{v}1(?: 0)?)?
sspl-1.0 | 3 | server | server side public licen[cs]e(?:{v}1(?: 0)?)?
busl-1.1 | 3 | business | business source licen[cs]e(?:{v}1 1)?
busl-1.1 | 3 | busl | busl 1 1
elastic-2.0 | 3 | elastic | elastic licen[cs]e(?:{v}2(?: 0)?)?
commons-clause | 3 | commons | commons clause(?: licen[cs]e)?(?: condition{v}1(?: 0)?)?
polyform | 3 | polyform | polyform(?: [a-z]+){1,2} licen[cs]e(?:{v}1 0 0)?
openrail | 3 | openrail | (?:[a-z]+ )?openrail(?: m)?(?: licen[cs]e)?
responsible-ai | 3 | responsible | responsible ai licen[cs]e

cc0-1.0 | 4 | waived | has waived all copyright and related or neighboring rights
cc0-1.0 | 3 | cc0 | cc0(?:{v}1(?: 0)?)?(?: universal)?
cc0-1.0 | 3 | zero | (?:creative commons|cc) zero(?:{v}1 0)?
cc0-1.0 | 4 | publicdomain | creativecommons org publicdomain zero 1 0
public-domain-mark | 4 | publicdomain | creativecommons org publicdomain mark 1 0
cc-by-4.0 | 4 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | 4 | creativecommons | creativecommons org licenses by 3 0
cc-by-2.5 | 4 | creativecommons | creativecommons org licenses by 2 5
cc-by-2.0 | 4 | creativecommons | creativecommons org licenses by 2 0
cc-by-sa-4.0 | 4 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 4 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | 4 | creativecommons | creativecommons org licenses by sa 2 5
cc-by-sa-2.0 | 4 | creativecommons | creativecommons org licenses by sa 2 0
cc-by-nc-4.0 | 4 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | 4 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | 4 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | 4 | creativecommons | creativecommons org licenses by nd 3 0
cc-by-nc-sa-4.0 | 4 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | 4 | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | 4 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | 4 | creativecommons | creativecommons org licenses by nc nd 3 0
cc-by-4.0 | 3 | cc | cc by{v}4(?: 0)?(?: international)?
cc-by-3.0 | 3 | cc | cc by{v}3(?: 0)?(?: unported)?
cc-by-2.5 | 3 | cc | cc by{v}2 5
cc-by-2.0 | 3 | cc | cc by{v}2 0
cc-by-sa-4.0 | 3 | cc | cc by sa{v}4(?: 0)?(?: international)?
cc-by-sa-3.0 | 3 | cc | cc by sa{v}3(?: 0)?(?: unported)?
cc-by-sa | 2 | cc | cc by sa
cc-by-nc-4.0 | 3 | cc | cc by nc{v}4(?: 0)?(?: international)?
cc-by-nc-3.0 | 3 | cc | cc by nc{v}3(?: 0)?(?: unported)?
cc-by-nc | 2 | cc | cc by nc
cc-by-nd-4.0 | 3 | cc | cc by nd{v}4(?: 0)?(?: international)?
cc-by-nd-3.0 | 3 | cc | cc by nd{v}3(?: 0)?(?: unported)?
cc-by-nd | 2 | cc | cc by nd
cc-by-nc-sa-4.0 | 3 | cc | cc by nc sa{v}4(?: 0)?(?: international)?
cc-by-nc-sa-3.0 | 3 | cc | cc by nc sa{v}3(?: 0)?(?: unported)?
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc-nd-4.0 | 3 | cc | cc by nc nd{v}4(?: 0)?(?: international)?
cc-by-nc-nd-3.0 | 3 | cc | cc by nc nd{v}3(?: 0)?(?: unported)?
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-4.0 | 3 | creative | creative commons attribution{v}4(?: 0)?(?: international)?(?: licen[cs]e)?
cc-by-3.0 | 3 | creative | creative commons attribution{v}3(?: 0)?(?: unported)?(?: licen[cs]e)?
cc-by | 2 | creative | creative commons attribution(?: licen[cs]e)?
cc-by-sa-4.0 | 3 | sharealike | creative commons attribution sharealike{v}4(?: 0)?(?: international)?(?: licen[cs]e)?
cc-by-sa-3.0 | 3 | sharealike | creative commons attribution sharealike{v}3(?: 0)?(?: unported)?(?: licen[cs]e)?
cc-by-sa | 2 | sharealike | creative commons attribution sharealike(?: licen[cs]e)?
cc-by-nc-4.0 | 3 | noncommercial | creative commons attribution noncommercial{v}4(?: 0)?(?: international)?(?: licen[cs]e)?
cc-by-nc | 2 | noncommercial | creative commons attribution noncommercial(?: licen[cs]e)?
cc-by-nc | 2 | commercial | creative commons attribution non commercial(?: licen[cs]e)?
cc-by-nd-4.0 | 3 | noderivatives | creative commons attribution noderivatives{v}4(?: 0)?(?: international)?(?: licen[cs]e)?
cc-by-nd | 2 | noderivatives | creative commons attribution noderivatives(?: licen[cs]e)?
cc-by-nd | 2 | noderivs | creative commons attribution noderivs(?: licen[cs]e)?
cc-by-nc-sa-4.0 | 3 | sharealike | creative commons attribution noncommercial sharealike{v}4(?: 0)?(?: international)?(?: licen[cs]e)?
cc-by-nc-sa | 2 | sharealike | creative commons attribution non commercial sharealike(?: licen[cs]e)?
cc-by-nc-nd | 2 | noderivatives | creative commons attribution noncommercial noderivatives(?: licen[cs]e)?
cc | 1 | creative | creative commons(?: licen[cs]e)?
odbl-1.0 | 3 | odbl | odbl(?: 1 0)?
odbl-1.0 | 3 | database | open database licen[cs]e(?:{v}1 0)?
odc-by-1.0 | 3 | attribution | open data commons attribution licen[cs]e
pddl-1.0 | 3 | dedication | public domain dedication and licen[cs]e
ogl-3.0 | 3 | government | open government licen[cs]e{v}3(?: 0)?
ogl | 2 | government | open government licen[cs]e
public-domain | 2 | domain | (?:released |placed |dedicated )?(?:into|in|to) the public domain
public-domain | 1 | domain | public domain

proprietary | 2 | confidential | confidential and proprietary
proprietary | 2 | proprietary | proprietary licen[cs]e
proprietary | 2 | reproduced | no part of this(?: [a-z]+){1,2} may be reproduced
proprietary | 2 | permission | (?:without|except with) the(?: prior)?(?: express)? written permission of
proprietary | 1 | proprietary | proprietary software
commercial | 2 | commercial | commercial licen[cs]e(?: agreement)?
eula | 2 | eula | eula
eula | 2 | user | end user licen[cs]e agreement
shareware | 1 | shareware | shareware
freeware | 1 | freeware | freeware
warranty-disclaimer | 2 | warranties | without warranties or conditions of any kind
warranty-disclaimer | 2 | warranty | without(?: any)? warranty of any kind
warranty-disclaimer | 1 | warranty | no warrant(?:y|ies)
dual | 2 | dual | dual licen[cs]ed?(?: under)?
open-source | 1 | open | open source licen[cs]ed?
free-software | 1 | free | this(?: program| library)? is free software
licensed | 1 | licensed | licensed under(?: the)?
licensed | 1 | license | (?:terms of the|see the|under the) license
licensed | 1 | licence | (?:terms of the|see the|under the) licence
licensed | 1 | license | license agreement
copyright | 1 | copyright | copyright(?: c)? (?:19|20)[0-9][0-9]
copyright | 1 | copyrighted | copyrighted (?:material|work|works)
"""

#: Labels of phrases that are told apart: all their places count, and nothing suppresses them.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
PRIORITIES = 4
#: How much a detection of a priority says that a licence is meant.
STRENGTH = {1: 0.25, 2: 0.5, 3: 0.8, 4: 0.95}


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keyword: str
    signature: str

    @property
    def base(self) -> bool:
        return BASE.get(self.label) == self.signature


def _rule(number: int, line: str) -> Rule:
    label, priority, keyword, signature = (x.strip() for x in line.split(" | "))
    return Rule(number, label, int(priority), keyword, signature)


def read_rules(text: str) -> list[Rule]:
    return [_rule(i, line) for i, line in enumerate(x for x in text.splitlines() if x.strip())]


def expanded(signature: str) -> str:
    """The signature with {v} and {w} written out; blanks still stand for what is between words."""
    return signature.replace("{v}", "(?: version| ver| v)? v?").replace("{w}", "(?: [^\\x00]+){0,6}?")


def over_numbered_words(signature: str) -> str:
    """As a pattern over words that are each followed by a zero byte and their number."""
    return rf"(?<![^ ])(?:{re.sub(' ', lambda _: chr(92) + 'x00[0-9]+ ', expanded(signature))})\x00[0-9]+"


RULES = read_rules(RULES_TEXT)
