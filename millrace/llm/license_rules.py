"""Signature rules of the licence scan, hand-written, one a line.

A rule is ``label | keyword | priority | score | regex``.  The regex matches whole words of a text in
which A-Z are lower case and words stand with one space between them; any run of ASCII characters
that are neither letters nor digits is a space.  The keyword must stand in the text, licence and its
forms spelt license, for the regex to be tried, and its words must be words of the text.  A smaller priority number wins over a larger one where detections overlap by containment.
1: an identifier or the licence's own words, 2: the licence named in full with its version,
3: named in a licensing sentence, 4: named without a version, 5: a general notice.
"""

from __future__ import annotations

RULES = r"""
mit | spdx | 1 | 1.0 | spdx license identifier mit
mit | mit license | 2 | 0.95 | the mit license(?: mit)?
mit | licensed under | 3 | 0.95 | licensed under (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: licen[sc]e)?
mit | mit licensed | 3 | 0.9 | mit licensed
mit | expat | 3 | 0.9 | (?:the )?expat licen[sc]e
mit | permission is hereby granted | 1 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice | 2 | 0.9 | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | opensource org | 2 | 0.95 | opensource org licen[sc]es mit(?: license)?
mit-0 | mit no attribution | 1 | 0.95 | mit no attribution(?: licen[sc]e)?
mit-0 | spdx | 1 | 1.0 | spdx license identifier mit 0
x11 | x11 | 3 | 0.9 | (?:the )?x11 licen[sc]e
apache-2 | spdx | 1 | 1.0 | spdx license identifier apache 2 0
apache-2 | apache license | 2 | 1.0 | apache licen[sc]e(?: version| v)? 2(?: 0)?
apache-2 | apache | 3 | 0.95 | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)? (?:version |v)?2(?: 0)?
apache-2 | apache | 3 | 0.9 | apache(?: licen[sc]e)? v?2(?: 0)? licen[sc]ed?
apache-2 | apache org | 2 | 0.95 | apache org licen[sc]es license 2 0
apache-2 | you may not use this file except | 1 | 0.95 | you may not use this file except in compliance with the license
apache-1.1 | apache | 2 | 0.95 | apache(?: software)? licen[sc]e version 1 1
apache-1.0 | apache | 2 | 0.95 | apache(?: software)? licen[sc]e version 1 0
apache | apache | 4 | 0.7 | apache(?: software)? licen[sc]e
bsd-3-clause | spdx | 1 | 1.0 | spdx license identifier bsd 3 clause
bsd-3-clause | bsd | 2 | 0.95 | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-3-clause | neither the name | 1 | 0.95 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-2-clause | spdx | 1 | 1.0 | spdx license identifier bsd 2 clause
bsd-2-clause | bsd | 2 | 0.95 | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)
bsd-4-clause | bsd | 2 | 0.95 | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd-4-clause | all advertising materials | 1 | 0.95 | all advertising materials mentioning features or use of this software must display
bsd-0-clause | bsd | 2 | 0.95 | (?:bsd zero clause|zero clause bsd|bsd 0 clause)(?: licen[sc]e)?
bsd-0-clause | 0bsd | 2 | 0.95 | 0bsd(?: licen[sc]e)?
bsd | redistribution and use | 2 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
bsd | bsd | 3 | 0.85 | (?:licen[sc]ed|released|distributed|available) under (?:the |a )?bsd(?: style)? licen[sc]e
bsd | bsd | 4 | 0.7 | bsd(?: style)? licen[sc]ed?
gpl-3 | spdx | 1 | 1.0 | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 | general public license | 2 | 1.0 | gnu general public licen[sc]e(?: as published by the free software foundation(?: either)?)?(?: version| v) ?3(?: 0)?
gpl-3 | gpl | 2 | 0.95 | (?:gnu )?gpl(?: version| v)? ?3(?: 0)?
gpl-3 | gplv3 | 2 | 0.95 | (?:gnu )?gplv3
gpl-3 | org licenses gpl 3 | 2 | 0.9 | gnu org licen[sc]es gpl 3 0
gpl-2 | spdx | 1 | 1.0 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 | general public license | 2 | 1.0 | gnu general public licen[sc]e(?: as published by the free software foundation(?: either)?)?(?: version| v) ?2(?: 0)?
gpl-2 | gpl | 2 | 0.95 | (?:gnu )?gpl(?: version| v)? ?2(?: 0)?
gpl-2 | gplv2 | 2 | 0.95 | (?:gnu )?gplv2
gpl-2 | org licenses old | 2 | 0.9 | gnu org licen[sc]es old licen[sc]es gpl 2 0
gpl-1 | general public license | 2 | 0.95 | gnu general public licen[sc]e version 1(?: 0)?
gpl | general public license | 4 | 0.8 | gnu general public licen[sc]e
gpl | gpl | 4 | 0.7 | (?:under|with) (?:the )?(?:gnu )?gpl
gpl | free software | 3 | 0.8 | this program is free software you can redistribute it and or modify it
lgpl-3 | spdx | 1 | 1.0 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | lesser general public license | 2 | 1.0 | (?:gnu )?lesser general public licen[sc]e(?: version| v) ?3(?: 0)?
lgpl-3 | lgpl | 2 | 0.95 | (?:gnu )?lgpl(?: version| v)? ?3(?: 0)?
lgpl-2.1 | spdx | 1 | 1.0 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | lesser general public license | 2 | 1.0 | (?:gnu )?lesser general public licen[sc]e(?: version| v) ?2 1
lgpl-2.1 | lgpl | 2 | 0.95 | (?:gnu )?lgpl(?: version| v)? ?2 1
lgpl-2 | library general public license | 2 | 1.0 | (?:gnu )?library general public licen[sc]e(?:(?: version| v) ?2(?: 0)?)?
lgpl | lesser general public license | 4 | 0.8 | (?:gnu )?lesser general public licen[sc]e
lgpl | lgpl | 4 | 0.7 | (?:gnu )?lgpl
agpl-3 | spdx | 1 | 1.0 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | affero general public license | 2 | 1.0 | (?:gnu )?affero general public licen[sc]e(?: version| v) ?3(?: 0)?
agpl-3 | agpl | 2 | 0.95 | (?:gnu )?agpl(?: version| v)? ?3(?: 0)?
agpl-3 | agplv3 | 2 | 0.95 | (?:gnu )?agplv3
agpl-1 | affero general public license | 2 | 0.95 | affero general public licen[sc]e version 1(?: 0)?
agpl | affero general public license | 4 | 0.8 | (?:gnu )?affero general public licen[sc]e
gfdl | free documentation license | 2 | 1.0 | gnu free documentation licen[sc]e(?:(?: version| v) ?1(?: [123])?)?
gfdl | spdx | 1 | 1.0 | spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl | gfdl | 3 | 0.8 | (?:under|with) (?:the )?gfdl
mpl-2 | spdx | 1 | 1.0 | spdx license identifier mpl 2 0
mpl-2 | mozilla public license | 2 | 1.0 | mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-2 | mpl | 2 | 0.9 | mpl(?: version| v)? ?2 0
mpl-2 | mozilla org mpl | 2 | 0.9 | mozilla org mpl 2 0
mpl-1.1 | mozilla public license | 2 | 1.0 | mozilla public licen[sc]e(?: version| v)? ?1 1
mpl-1.0 | mozilla public license | 2 | 1.0 | mozilla public licen[sc]e(?: version| v)? ?1 0
mpl | mozilla public license | 4 | 0.8 | mozilla public licen[sc]e
epl-2 | spdx | 1 | 1.0 | spdx license identifier epl 2 0
epl-2 | eclipse public license | 2 | 1.0 | eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-1 | eclipse public license | 2 | 1.0 | eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
epl | eclipse public license | 4 | 0.8 | eclipse public licen[sc]e
edl | eclipse distribution license | 2 | 0.95 | eclipse distribution licen[sc]e(?:(?: version| v)? ?1 0)?
cddl-1 | spdx | 1 | 1.0 | spdx license identifier cddl 1 [01]
cddl-1 | common development and distribution | 2 | 1.0 | common development and distribution licen[sc]e(?:(?: version| v)? ?1 [01])?
cddl-1 | cddl | 3 | 0.8 | (?:under|with) (?:the )?cddl
cpl | common public license | 2 | 0.95 | common public licen[sc]e(?:(?: version| v)? ?1 0)?
ipl | ibm public license | 2 | 0.95 | ibm public licen[sc]e(?:(?: version| v)? ?1 0)?
eupl | european union public | 2 | 1.0 | european union public licen[sc]e(?:(?: version| v)? ?1 [012])?
eupl | eupl | 3 | 0.9 | eupl(?:(?: version| v)? ?1 [012])?
isc | spdx | 1 | 1.0 | spdx license identifier isc
isc | isc | 2 | 0.95 | (?:the )?isc licen[sc]e
isc | permission to use copy modify | 1 | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission to use copy modify | 1 | 0.85 | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
zlib | spdx | 1 | 1.0 | spdx license identifier zlib
zlib | zlib | 2 | 0.9 | (?:the )?zlib(?: libpng)? licen[sc]e
zlib | this software is provided as is | 1 | 0.9 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | libpng | 2 | 0.9 | (?:the )?libpng licen[sc]e(?: version 2)?
bsl-1.0 | boost software license | 2 | 1.0 | boost software licen[sc]e(?:(?: version| v)? ?1 0)?
bsl-1.0 | spdx | 1 | 1.0 | spdx license identifier bsl 1 0
busl-1.1 | business source license | 2 | 1.0 | business source licen[sc]e(?:(?: version| v)? ?1 1)?
busl-1.1 | spdx | 1 | 1.0 | spdx license identifier busl 1 1
artistic-2 | artistic license | 2 | 1.0 | artistic licen[sc]e(?: version| v)? ?2(?: 0)?
artistic-1 | artistic license | 2 | 0.95 | artistic licen[sc]e(?: version| v)? ?1(?: 0)?
artistic | artistic license | 4 | 0.8 | (?:perl )?artistic licen[sc]e
perl | terms as perl itself | 2 | 0.95 | under the same terms as perl itself
psf-2 | python software foundation | 2 | 0.95 | python software foundation licen[sc]e(?:(?: version| v)? ?2(?: 0)?)?
python | python license | 3 | 0.85 | (?:the )?python licen[sc]e
php-3 | php license | 2 | 0.95 | php licen[sc]e(?:(?: version| v)? ?3(?: 0[01]?)?)?
ruby | ruby | 3 | 0.85 | (?:the )?ruby licen[sc]e
openssl | openssl | 2 | 0.9 | (?:the )?openssl(?: ssleay)? licen[sc]e
postgresql | postgresql | 2 | 0.9 | (?:the )?postgresql licen[sc]e
unlicense | unlicense | 2 | 0.95 | (?:released|licen[sc]ed|available|distributed) under (?:the )?unlicense
unlicense | unlicense | 3 | 0.9 | the unlicense
unlicense | spdx | 1 | 1.0 | spdx license identifier unlicense
unlicense | free and unencumbered | 1 | 1.0 | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | 2 | 0.95 | wtfpl(?:(?: version| v)? ?2)?
wtfpl | do what the | 1 | 1.0 | do what the fuck you want to public licen[sc]e
beerware | beer ware | 2 | 0.95 | (?:the )?beer ware licen[sc]e
beerware | beerware | 2 | 0.9 | (?:the )?beerware licen[sc]e
public-domain | public domain | 3 | 0.9 | (?:released|placed|dedicated|donated|put|is|are) (?:in|into|in to|to) the public domain
public-domain | public domain | 3 | 0.85 | public domain (?:dedication|mark|work|software|notice)
cc0-1.0 | cc0 | 2 | 1.0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | cc zero | 2 | 0.9 | cc zero
cc0-1.0 | creative commons zero | 2 | 0.9 | creative commons zero
cc0-1.0 | publicdomain zero | 2 | 0.95 | creativecommons org publicdomain zero 1 0
cc-by-nc | cc by nc | 2 | 0.95 | cc by nc(?: [1234] [05])?
cc-by-nc-sa | cc by nc sa | 1 | 1.0 | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc by nc nd | 1 | 1.0 | cc by nc nd(?: [1234] [05])?
cc-by-nd | cc by nd | 1 | 1.0 | cc by nd(?: [1234] [05])?
cc-by-sa | cc by sa | 1 | 1.0 | cc by sa(?: [1234] [05])?
cc-by | cc by | 2 | 0.95 | cc by [1234] [05]
cc-by | under cc by | 4 | 0.8 | under cc by(?! nc| nd| sa)
cc-by-nc-sa | attribution non | 1 | 1.0 | (?:creative commons )?attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nc-nd | attribution non | 1 | 1.0 | (?:creative commons )?attribution non ?commercial no ?deriv(?:s|atives)(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nc | attribution noncommercial | 2 | 1.0 | (?:creative commons )?attribution noncommercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nc | attribution non commercial | 2 | 1.0 | (?:creative commons )?attribution non commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-sa | attribution sharealike | 2 | 1.0 | (?:creative commons )?attribution sharealike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-sa | attribution share alike | 2 | 1.0 | (?:creative commons )?attribution share alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nd | attribution no | 2 | 1.0 | (?:creative commons )?attribution no ?deriv(?:s|atives)(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by | creative commons attribution | 3 | 0.95 | creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by | licenses by | 2 | 1.0 | creativecommons org licen[sc]es by [1234] [05]
cc-by-sa | licenses by sa | 1 | 1.0 | creativecommons org licen[sc]es by sa [1234] [05]
cc-by-nc | licenses by nc | 1 | 1.0 | creativecommons org licen[sc]es by nc [1234] [05]
cc-by-nd | licenses by nd | 1 | 1.0 | creativecommons org licen[sc]es by nd [1234] [05]
cc-by-nc-sa | licenses by nc sa | 1 | 1.0 | creativecommons org licen[sc]es by nc sa [1234] [05]
cc-by-nc-nd | licenses by nc nd | 1 | 1.0 | creativecommons org licen[sc]es by nc nd [1234] [05]
creative-commons | creative commons | 4 | 0.7 | creative commons licen[sc]e
odbl-1.0 | open database license | 2 | 1.0 | open database licen[sc]e(?: odbl)?(?:(?: version| v)? ?1 0)?
odbl-1.0 | odbl | 3 | 0.9 | odbl(?: 1 0)?
odc-by-1.0 | open data commons | 2 | 1.0 | open data commons attribution licen[sc]e(?: 1 0)?
odc-by-1.0 | odc by | 3 | 0.9 | odc by(?: 1 0)?
pddl-1.0 | public domain dedication and | 2 | 1.0 | public domain dedication and licen[sc]e(?: 1 0)?
cdla-permissive | community data license | 2 | 1.0 | community data licen[sc]e agreement permissive(?:(?: version)? [12] 0)?
cdla-sharing | community data license | 2 | 1.0 | community data licen[sc]e agreement sharing(?:(?: version)? 1 0)?
ogl-uk | open government licence | 2 | 0.95 | open government licence(?:(?: version| v)? ?[123](?: 0)?)?
etalab | etalab | 2 | 0.9 | (?:licence ouverte|open licen[sc]e)(?: open licen[sc]e)? etalab(?: 2 0)?
dl-de-by | datenlizenz deutschland | 2 | 0.95 | datenlizenz deutschland namensnennung(?:(?: version)? 2 0)?
dl-de-zero | datenlizenz deutschland | 2 | 0.95 | datenlizenz deutschland zero(?:(?: version)? 2 0)?
ofl-1.1 | open font license | 2 | 1.0 | (?:sil )?open font licen[sc]e(?:(?: version| v)? ?1 [01])?
ofl-1.1 | spdx | 1 | 1.0 | spdx license identifier ofl 1 1
ubuntu-font | ubuntu font | 2 | 0.95 | ubuntu font licen[sc]e(?:(?: version| v)? ?1 0)?
bitstream-vera | bitstream vera | 2 | 0.9 | bitstream vera(?: font)? licen[sc]e
free-art | free art license | 2 | 0.95 | free art licen[sc]e(?: 1 [23])?
ms-pl | microsoft public license | 2 | 0.95 | microsoft public licen[sc]e(?: ms pl)?
ms-pl | ms pl | 3 | 0.85 | (?:under|with) (?:the )?ms pl
ms-rl | microsoft reciprocal | 2 | 0.95 | microsoft reciprocal licen[sc]e(?: ms rl)?
apsl-2 | apple public source | 2 | 0.95 | apple public source licen[sc]e(?:(?: version| v)? ?2 0)?
osl-3 | open software license | 2 | 0.95 | open software licen[sc]e(?:(?: version| v)? ?3 0)?
afl-3 | academic free license | 2 | 0.95 | academic free licen[sc]e(?:(?: version| v)? ?[123] [01])?
cecill | cecill | 2 | 0.95 | cecill(?: [abc])?(?: licen[sc]e)?(?:(?: version| v)? ?2(?: [01])?)?
qpl | q public license | 2 | 0.95 | q public licen[sc]e(?:(?: version| v)? ?1 0)?
sleepycat | sleepycat | 2 | 0.95 | (?:the )?sleepycat licen[sc]e
ncsa | illinois ncsa | 2 | 0.95 | (?:university of )?illinois ncsa open source licen[sc]e
upl-1.0 | universal permissive | 2 | 0.95 | universal permissive licen[sc]e(?:(?: version| v)? ?1 0)?
mulan-psl | mulan | 2 | 0.95 | mulan permissive software licen[sc]e(?:(?: version| v)? ?[12](?: 0)?)?
mulan-psl | mulan psl | 2 | 0.95 | mulan psl v?[12](?: 0)?
vim | vim | 3 | 0.85 | (?:the )?vim licen[sc]e
lppl-1.3 | latex project public | 2 | 0.95 | latex project public licen[sc]e(?:(?: version| v)? ?1 [0-3]c?)?
lppl-1.3 | lppl | 3 | 0.85 | lppl(?:(?: version| v)? ?1 [0-3]c?)?
w3c | w3c | 2 | 0.9 | w3c(?: software)?(?: notice and)?(?: document)? licen[sc]e
unicode | unicode | 2 | 0.9 | unicode(?: inc)? licen[sc]e(?: agreement)?
icu | icu license | 2 | 0.9 | (?:the )?icu licen[sc]e
curl | curl license | 2 | 0.85 | (?:the )?curl licen[sc]e
json | good not evil | 1 | 0.95 | the software shall be used for good not evil
sspl-1.0 | server side public | 2 | 1.0 | server side public licen[sc]e(?:(?: version| v)? ?1(?: 0)?)?
sspl-1.0 | sspl | 3 | 0.85 | (?:under|with) (?:the )?sspl
elastic-2.0 | elastic license | 2 | 0.95 | elastic licen[sc]e(?:(?: version| v)? ?2(?: 0)?)?
confluent-community | confluent community | 2 | 0.95 | confluent community licen[sc]e(?:(?: version| v)? ?1 0)?
commons-clause | commons clause | 2 | 0.95 | commons clause(?: licen[sc]e)?(?: condition)?(?:(?: version| v)? ?1 0)?
polyform | polyform | 2 | 0.95 | polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial) licen[sc]e(?: 1 0 [01])?
fsl | functional source license | 2 | 0.95 | functional source licen[sc]e(?:(?: version| v)? ?1 [01])?
openrail | openrail | 2 | 0.95 | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
openrail | open rail | 2 | 0.95 | (?:creativeml |bigscience )?open rail(?: m)?(?: licen[sc]e)?
rail | responsible ai license | 2 | 0.95 | (?:bigscience )?(?:open )?responsible ai licen[sc]e
llama | llama | 2 | 0.9 | llama (?:[234](?: [0-9])? )?community licen[sc]e(?: agreement)?
gemma | gemma terms | 2 | 0.9 | gemma terms of use
nvidia-open-model | nvidia open model | 2 | 0.9 | nvidia open model licen[sc]e
research-only | research | 3 | 0.8 | (?:for )?(?:non ?commercial )?research(?: and educational)?(?: use| purposes?) only
non-commercial | non commercial | 3 | 0.8 | (?:for )?non commercial (?:use|purposes?)(?: only)?
non-commercial | noncommercial | 3 | 0.8 | (?:for )?noncommercial (?:use|purposes?)(?: only)?
proprietary | proprietary | 3 | 0.85 | (?:this (?:software|document|work|text) is )?(?:confidential and )?proprietary(?: and confidential)?(?: information)?
proprietary | strictly prohibited | 3 | 0.85 | (?:unauthori[sz]ed )?(?:copying|reproduction|distribution)(?: or distribution)?(?: of this (?:file|work|document|text))?(?: via any medium)? is strictly prohibited
proprietary | may not be reproduced | 3 | 0.85 | (?:no part of this .{1,40}?|this .{1,40}?) may not be reproduced(?: in any form)?
proprietary | no part of this | 3 | 0.85 | no part of this (?:publication|book|work|document|text) may be reproduced
proprietary | end user license | 3 | 0.85 | end user licen[sc]e agreement
all-rights-reserved | rights reserved | 5 | 0.6 | (?:all|some|no) rights reserved
all-rights-reserved | reservados | 5 | 0.6 | todos los derechos reservados
all-rights-reserved | rechte vorbehalten | 5 | 0.6 | alle rechte vorbehalten
all-rights-reserved | droits | 5 | 0.6 | tous droits r.serv.s
copyright | copyright | 5 | 0.5 | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | copyrighted | 5 | 0.5 | (?:this (?:work|document|text|software) is )?copyrighted(?: material| work)?
dual-license | dual licensed | 4 | 0.7 | dual licensed(?: under)?
spdx-other | spdx | 5 | 0.6 | spdx license identifier [a-z0-9]+
unspecified-license | license agreement | 5 | 0.5 | (?:the |this )?licen[sc]e agreement
unspecified-license | see the license | 5 | 0.5 | see the licen[sc]e(?: file)? for
unspecified-license | license file | 5 | 0.5 | see (?:the )?(?:accompanying |included )?licen[sc]e file
unspecified-license | lizenziert unter | 5 | 0.5 | lizenziert unter(?: der| einer| den)? (?:[a-z0-9]+ ){0,4}?lizenz
unspecified-license | sous licence | 5 | 0.5 | (?:distribu. |publi. |diffus. )?sous licence [a-z0-9]+
unspecified-license | bajo la licencia | 5 | 0.5 | bajo la licencia [a-z0-9]+
unspecified-license | bajo licencia | 5 | 0.5 | bajo licencia [a-z0-9]+
trademark | registered trademark | 5 | 0.4 | (?:is a |are )?registered trademarks?(?: of)?
warranty-disclaimer | without warranty | 5 | 0.4 | without warranty of any kind(?: express or implied)?
warranty-disclaimer | merchantability | 5 | 0.4 | (?:implied )?warranty of merchantability(?: or fitness for a particular purpose)?
"""


def rules() -> list[tuple[str, str, int, float, str]]:
    """label, keyword, priority, score and regex of each rule, in order."""
    out = []
    for line in RULES.strip().splitlines():
        label, keyword, priority, score, regex = line.split(" | ", 4)
        out.append((label.strip(), keyword.strip(), int(priority), float(score), regex.strip()))
    return out
