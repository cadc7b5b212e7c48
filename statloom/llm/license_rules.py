"""Signature rules of the license scan, written by hand, in order of priority.

One rule a line: label | keyword | score | expression.  The expression stands for whole words of the
normalised text (lower-case words parted by one space), the keyword in everything that it matches.
``@`` is an optional "version" or "v" before a number; an expression has no unbounded repeats.
"""

from __future__ import annotations

#: Words of the longest match at most.
LONGEST = 64

RULES_TEXT = r"""
mit | spdx | 1 | spdx license identifier mit
mit-0 | spdx | 1 | spdx license identifier mit 0
apache-2.0 | spdx | 1 | spdx license identifier apache 2 0
apache-1.1 | spdx | 1 | spdx license identifier apache 1 1
bsd-2-clause | spdx | 1 | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | 1 | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | 1 | spdx license identifier bsd 4 clause
0bsd | spdx | 1 | spdx license identifier 0bsd
isc | spdx | 1 | spdx license identifier isc
zlib | spdx | 1 | spdx license identifier zlib
gpl-2.0 | spdx | 1 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | spdx | 1 | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.1 | spdx | 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx | 1 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | spdx | 1 | spdx license identifier agpl 3 0(?: only| or later)?
mpl-2.0 | spdx | 1 | spdx license identifier mpl 2 0
epl-2.0 | spdx | 1 | spdx license identifier epl 2 0
bsl-1.0 | spdx | 1 | spdx license identifier bsl 1 0
unlicense | spdx | 1 | spdx license identifier unlicense
cc0-1.0 | spdx | 1 | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | 1 | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | 1 | spdx license identifier cc by sa 4 0
spdx-other | spdx | 0.8 | spdx license identifier [a-z0-9]{2,12}
mit | permission is hereby granted | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | permission is hereby granted | 0.9 | permission is hereby granted free of charge to any person obtaining a copy
mit | permission notice | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | without warranty of any kind | 0.8 | the software is provided as is without warranty of any kind express or implied
x11 | x consortium | 0.9 | except as contained in this notice the name of the x consortium shall not be used
isc | permission to use copy modify | 1 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission to use copy modify | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted
bsd-3-clause | neither the name of | 1 | neither the name of (?:the )?(?:[a-z0-9]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | 1 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | redistributions of source code | 0.9 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions in binary form | 0.9 | redistributions in binary form must reproduce the above copyright notice
bsd | redistribution and use | 0.8 | redistribution and use in source and binary forms with or without modification are permitted
zlib | plainly marked as such | 1 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software | 0.9 | the origin of this software must not be misrepresented
apache-2.0 | in compliance with the license | 1 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | in compliance with the license | 0.8 | you may not use this file except in compliance with the license
apache-2.0 | limitations under the license | 0.8 | see the license for the specific language governing permissions and limitations under the license
apache-1.1 | apache software foundation | 0.9 | this product includes software developed by the apache software foundation
openssl | openssl | 0.9 | this product includes software developed by the openssl project
gpl-2.0 | free software foundation | 1 | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | free software foundation | 1 | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1 | free software foundation | 1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3.0 | free software foundation | 1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
agpl-3.0 | free software foundation | 1 | under the terms of the gnu affero general public license as published by the free software foundation
gpl | general public license for more | 0.8 | see the gnu general public license for more details
lgpl | general public license for more | 0.8 | see the gnu lesser general public license for more details
agpl | general public license for more | 0.8 | see the gnu affero general public license for more details
gpl | copy of the gnu | 0.8 | you should have received a copy of the gnu general public license along with this (?:program|file|software|library)
mpl-2.0 | mozilla public | 1 | subject to the terms of the mozilla public license v 2 0
mpl-2.0 | was not distributed with this file | 0.9 | if a copy of the mpl was not distributed with this file
mpl-1.1 | mozilla public | 1 | subject to the mozilla public license version 1 1
epl-2.0 | eclipse public | 1 | made available under the terms of the eclipse public license 2 0
epl-1.0 | eclipse public | 1 | made available under the terms of the eclipse public license v1 0
cddl-1.0 | common development | 1 | subject to the terms of the common development and distribution license
unlicense | unencumbered software | 1 | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | do what the fuck | 1 | do what the fuck you want to public license
wtfpl | do what the fuck | 0.9 | you just do what the fuck you want to
beerware | buy me a beer | 1 | you can buy me a beer in return
cc0-1.0 | related or neighboring rights | 1 | waived all copyright and related or neighboring rights
cc0-1.0 | possible under law | 0.8 | to the extent possible under law
gfdl | invariant sections | 1 | with no invariant sections no front cover texts and no back cover texts
gfdl | free documentation | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
ofl-1.1 | open font | 1 | this font software is licensed under the sil open font license version 1 1
artistic | standard version | 0.8 | you may distribute the standard version of this package
json | good not evil | 1 | the software shall be used for good not evil
boost | machine executable object | 0.9 | machine executable object code generated by a source language processor
postgresql | university of california | 0.9 | in no event shall the university of california be liable to any party
ncsa | university of illinois | 0.9 | university of illinois ncsa open source license
mit | mit | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?
expat | expat | 0.9 | licen[cs]ed under (?:the )?expat(?: licen[cs]e)?
mit | mit | 0.95 | (?:released|distributed|published|available|provided) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?
mit | mit | 0.9 | (?:see|read) the mit licen[cs]e
mit | mit | 0.7 | mit x11 licen[cs]e
mit | mit | 0.7 | (?:the )?mit licen[cs]e
mit-0 | mit no attribution | 0.9 | mit no attribution(?: licen[cs]e)?
expat | expat | 0.7 | expat licen[cs]e
apache-2.0 | apache | 0.95 | licen[cs]ed (?:to you )?under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e@2(?: 0)?
apache-2.0 | apache | 0.95 | (?:released|distributed|published|available|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?@2(?: 0)?
apache-1.1 | apache | 0.95 | licen[cs]ed under (?:the )?apache(?: software)? licen[cs]e@1 1
apache-2.0 | apache | 0.9 | apache(?: software)? licen[cs]e@2(?: 0)?
apache-1.1 | apache | 0.9 | apache(?: software)? licen[cs]e@1 1
apache-1.0 | apache | 0.9 | apache(?: software)? licen[cs]e@1 0
apache-2.0 | apache 2 | 0.8 | apache 2(?: 0)? licen[cs]e
apache-2.0 | asl | 0.7 | asl 2 0
apache | apache | 0.85 | licen[cs]ed under (?:the )?apache(?: licen[cs]e)?
apache | apache | 0.6 | apache(?: software| public)? licen[cs]e
bsd-2-clause | bsd | 0.95 | licen[cs]ed under (?:the )?(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-3-clause | bsd | 0.95 | licen[cs]ed under (?:the )?(?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-4-clause | bsd | 0.95 | licen[cs]ed under (?:the )?(?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?
bsd-2-clause | bsd | 0.9 | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e
bsd-3-clause | bsd | 0.9 | (?:new|revised|modified|3 clause|three clause) bsd licen[cs]e
bsd-4-clause | bsd | 0.9 | (?:original|old|4 clause|four clause) bsd licen[cs]e
bsd-2-clause | bsd | 0.85 | bsd 2 clause(?: licen[cs]e)?
bsd-3-clause | bsd | 0.85 | bsd 3 clause(?: clear)?(?: licen[cs]e)?
bsd-4-clause | bsd | 0.85 | bsd 4 clause(?: licen[cs]e)?
0bsd | bsd | 0.85 | (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?
bsd | bsd | 0.85 | (?:licen[cs]ed|released|distributed|available) under (?:the |a )?bsd(?: style)?(?: licen[cs]e)?
bsd | bsd | 0.6 | bsd(?: style)? licen[cs]e
isc | isc | 0.9 | (?:licen[cs]ed|released|distributed) under (?:the )?isc(?: licen[cs]e)?
isc | isc | 0.6 | isc licen[cs]e
zlib | zlib | 0.9 | (?:licen[cs]ed|released|distributed) under (?:the )?zlib(?: libpng)?(?: licen[cs]e)?
zlib | zlib | 0.7 | zlib(?: libpng)? licen[cs]e
libpng | libpng | 0.7 | libpng licen[cs]e
agpl-3.0 | affero | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?(?:gnu )?affero general public licen[cs]e@3(?: 0)?
agpl-3.0 | affero | 0.9 | (?:gnu )?affero general public licen[cs]e@3(?: 0)?
agpl-1.0 | affero | 0.9 | affero general public licen[cs]e@1(?: 0)?
agpl | affero | 0.8 | (?:gnu )?affero general public licen[cs]e
agpl-3.0 | agpl | 0.85 | (?:gnu )?agpl@3(?: 0)?(?: or later)?
agpl-3.0 | agplv3 | 0.85 | agplv3
agpl | agpl | 0.7 | agpl licen[cs]ed?
lgpl-2.1 | lesser | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[cs]e@2 1
lgpl-3.0 | lesser | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[cs]e@3(?: 0)?
lgpl-2.1 | lesser | 0.9 | (?:gnu )?lesser general public licen[cs]e@2 1
lgpl-3.0 | lesser | 0.9 | (?:gnu )?lesser general public licen[cs]e@3(?: 0)?
lgpl-2.0 | library general | 0.9 | (?:gnu )?library general public licen[cs]e@2(?: 0)?
lgpl | lesser | 0.8 | (?:gnu )?lesser general public licen[cs]e
lgpl | library general | 0.8 | (?:gnu )?library general public licen[cs]e
lgpl-2.1 | lgpl | 0.85 | (?:gnu )?lgpl@2 1(?: or later)?
lgpl-3.0 | lgpl | 0.85 | (?:gnu )?lgpl@3(?: 0)?(?: or later)?
lgpl-2.0 | lgpl | 0.85 | (?:gnu )?lgpl@2(?: 0)?
lgpl-2.1 | lgplv2 | 0.85 | lgplv2 1
lgpl-3.0 | lgplv3 | 0.85 | lgplv3
lgpl | lgpl | 0.7 | lgpl licen[cs]ed?
gpl-1.0 | general public | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e@1(?: 0)?
gpl-2.0 | general public | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e@2(?: 0)?
gpl-3.0 | general public | 0.95 | licen[cs]ed under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e@3(?: 0)?
gpl-1.0 | general public | 0.9 | (?:gnu )?general public licen[cs]e@1(?: 0)?
gpl-2.0 | general public | 0.9 | (?:gnu )?general public licen[cs]e@2(?: 0)?(?: only| or later)?
gpl-3.0 | general public | 0.9 | (?:gnu )?general public licen[cs]e@3(?: 0)?(?: only| or later)?
gpl-2.0 | gpl | 0.85 | (?:gnu )?gpl@2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl | 0.85 | (?:gnu )?gpl@3(?: 0)?(?: only| or later)?
gpl-2.0 | gplv2 | 0.85 | gplv2
gpl-3.0 | gplv3 | 0.85 | gplv3
gpl | general public | 0.8 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e
gpl | gpl | 0.8 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl
gpl | general public | 0.6 | gnu general public licen[cs]e
gpl | gpl | 0.6 | (?:gnu gpl|gpl licen[cs]ed?)
gpl-exception | classpath | 0.8 | (?:with )?(?:the )?classpath exception
gpl-exception | exception | 0.8 | (?:gcc runtime library|static|linking) (?:library )?(?:linking )?exception
mpl-2.0 | mozilla | 0.9 | mozilla public licen[cs]e@2(?: 0)?
mpl-1.1 | mozilla | 0.9 | mozilla public licen[cs]e@1 1
mpl-1.0 | mozilla | 0.9 | mozilla public licen[cs]e@1 0
mpl | mozilla | 0.7 | mozilla public licen[cs]e
mpl-2.0 | mpl | 0.8 | mpl@2 0
mpl-1.1 | mpl | 0.8 | mpl@1 1
epl-2.0 | eclipse | 0.9 | eclipse public licen[cs]e@2(?: 0)?
epl-1.0 | eclipse | 0.9 | eclipse public licen[cs]e@1(?: 0)?
epl | eclipse | 0.7 | eclipse public licen[cs]e
edl-1.0 | eclipse | 0.9 | eclipse distribution licen[cs]e@1(?: 0)?
cpl-1.0 | common public | 0.9 | common public licen[cs]e@1(?: 0)?
ipl-1.0 | ibm public | 0.9 | ibm public licen[cs]e@1(?: 0)?
cddl-1.1 | common development | 0.9 | common development and distribution licen[cs]e@1 1
cddl-1.0 | common development | 0.9 | common development and distribution licen[cs]e@1 0
cddl | cddl | 0.7 | cddl(?:@1 [01])?
eupl-1.2 | european union public | 0.9 | european union public licen[cs]e@1 2
eupl-1.1 | european union public | 0.9 | european union public licen[cs]e@1 1
eupl | eupl | 0.8 | eupl(?:@1 [012])?
cecill-2.1 | cecill | 0.9 | cecill(?: licen[cs]e)?@2 1
cecill-b | cecill | 0.9 | cecill b(?: licen[cs]e)?
cecill-c | cecill | 0.9 | cecill c(?: licen[cs]e)?
artistic-2.0 | artistic | 0.9 | artistic licen[cs]e@2(?: 0)?
artistic-1.0 | artistic | 0.9 | artistic licen[cs]e@1(?: 0)?
artistic | artistic | 0.7 | artistic licen[cs]e
perl | perl itself | 0.9 | under the same terms as perl itself
ruby | ruby | 0.8 | (?:ruby s licen[cs]e|ruby licen[cs]e)
php-3.01 | php | 0.9 | php licen[cs]e@3 0?1
python-2.0 | python | 0.9 | python software foundation licen[cs]e(?:@2)?
python | psf | 0.8 | psf licen[cs]e(?: agreement)?
bsl-1.0 | boost | 0.9 | boost software licen[cs]e@1(?: 0)?
boost | boost | 0.7 | boost(?: software)? licen[cs]e
busl-1.1 | business source | 0.9 | business source licen[cs]e@1 1
busl | business source | 0.8 | business source licen[cs]e
sspl-1.0 | server side public | 0.9 | server side public licen[cs]e(?:@1)?
sspl-1.0 | sspl | 0.8 | sspl(?:@1)?(?: licen[cs]e)?
elastic-2.0 | elastic | 0.9 | elastic licen[cs]e@2(?: 0)?
elastic | elastic | 0.7 | elastic licen[cs]e
polyform | polyform | 0.9 | polyform (?:noncommercial|small business|perimeter|shield|strict)(?: licen[cs]e)?
commons-clause | commons clause | 0.9 | commons clause(?: licen[cs]e)?(?: condition)?
confluent | confluent | 0.9 | confluent community licen[cs]e
redis-rsal | redis source | 0.9 | redis source available licen[cs]e
fsl | functional source | 0.9 | functional source licen[cs]e
unlicense | unlicense | 0.8 | (?:the )?unlicense
wtfpl | wtfpl | 0.9 | wtfpl(?:@2)?
cc0-1.0 | cc0 | 0.9 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | 0.9 | creative commons zero(?:@1 0)?
cc-by-nc-nd | cc by nc nd | 0.95 | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | cc by nc sa | 0.95 | cc by nc sa(?: [1-4] [05])?
cc-by-nc | cc by nc | 0.9 | cc by nc(?: [1-4] [05])?
cc-by-nd | cc by nd | 0.9 | cc by nd(?: [1-4] [05])?
cc-by-sa | cc by sa | 0.9 | cc by sa(?: [1-4] [05])?
cc-by | cc by | 0.8 | cc by(?: [1-4] [05])?
cc-by-nc-nd | creative commons attribution | 0.95 | creative commons attribution non ?commercial no ?deriv(?:ative|s)?(?:s|atives)?(?: [1-4] [05])?
cc-by-nc-sa | creative commons attribution | 0.95 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc | creative commons attribution | 0.9 | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd | creative commons attribution | 0.9 | creative commons attribution no ?deriv(?:atives|s)?(?: [1-4] [05])?
cc-by-sa | creative commons attribution | 0.9 | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by | creative commons attribution | 0.85 | creative commons attribution(?: [1-4] [05])?(?: international| unported)?
cc | creative commons | 0.5 | creative commons licen[cs]e
odbl-1.0 | open database | 0.9 | (?:open data commons )?open database licen[cs]e(?:@1 0)?
odbl-1.0 | odbl | 0.8 | odbl(?: 1 0)?
odc-by | open data commons | 0.9 | open data commons attribution licen[cs]e
pddl-1.0 | public domain dedication | 0.9 | public domain dedication and licen[cs]e
cdla-permissive | community data license | 0.9 | community data license agreement permissive
cdla-sharing | community data license | 0.9 | community data license agreement sharing
ogl-uk | open government | 0.9 | open government licen[cs]e(?:@[123] 0)?
etalab | licence ouverte | 0.9 | licence ouverte(?: open licence)?
ofl-1.1 | open font | 0.9 | (?:sil )?open font licen[cs]e(?:@1 1)?
gfdl-1.3 | free documentation | 0.9 | (?:gnu )?free documentation licen[cs]e@1 3
gfdl | free documentation | 0.8 | (?:gnu )?free documentation licen[cs]e
gfdl | gfdl | 0.8 | gfdl(?: 1 [123])?
openrail | openrail | 0.9 | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?
llama | llama | 0.8 | llama [1-4]? ?community licen[cs]e(?: agreement)?
gemma | gemma | 0.8 | gemma terms of use
rail | responsible ai | 0.8 | responsible ai licen[cs]e
upl-1.0 | universal permissive | 0.9 | universal permissive licen[cs]e(?:@1 0)?
ms-pl | microsoft public | 0.9 | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | 0.9 | microsoft reciprocal licen[cs]e
postgresql | postgresql | 0.8 | postgresql licen[cs]e
vim | vim | 0.8 | vim licen[cs]e
curl | curl | 0.8 | curl licen[cs]e
openldap | openldap | 0.8 | openldap public licen[cs]e
qpl-1.0 | q public | 0.9 | q public licen[cs]e(?:@1 0)?
sleepycat | sleepycat | 0.8 | sleepycat licen[cs]e
w3c | w3c | 0.8 | w3c software (?:notice and )?licen[cs]e
zpl-2.1 | zope public | 0.9 | zope public licen[cs]e(?:@2 [01])?
afl-3.0 | academic free | 0.9 | academic free licen[cs]e(?:@3 0)?
osl-3.0 | open software license | 0.9 | open software license(?:@3 0)?
mulan-2.0 | mulan | 0.9 | mulan psl(?:@2)?
blueoak-1.0 | blue oak | 0.9 | blue oak model licen[cs]e(?: 1 0 0)?
hippocratic | hippocratic | 0.9 | hippocratic licen[cs]e
public-domain | public domain | 0.8 | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain | public domain | 0.5 | (?:in )?the public domain
proprietary | proprietary and confidential | 0.9 | (?:this (?:document|file|software) is )?proprietary and confidential
proprietary | strictly confidential | 0.7 | strictly confidential
proprietary | unauthori | 0.8 | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)
proprietary | may not be reproduced | 0.8 | may not be reproduced (?:or transmitted )?in any form
proprietary | end user license | 0.7 | end user license agreement
proprietary | commercial licen | 0.6 | (?:under a |a )?commercial licen[cs]e
proprietary | trade secret | 0.6 | trade secrets? of
all-rights-reserved | all rights reserved | 0.6 | all rights reserved
some-rights-reserved | some rights reserved | 0.6 | some rights reserved
copyright-notice | copyright | 0.5 | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright-notice | spdx filecopyrighttext | 0.6 | spdx filecopyrighttext
non-commercial | commercial | 0.5 | (?:for )?non ?commercial (?:use|purposes)(?: only)?
research-only | research | 0.5 | for research (?:use|purposes) only
personal-use | personal use | 0.5 | for personal use only
no-derivatives | derivative works | 0.4 | no derivative works
attribution-required | attribution required | 0.5 | attribution required
no-warranty | warranty | 0.3 | without (?:any )?warranty(?: of any kind)?
no-warranty | warranties | 0.3 | disclaims? all (?:express or implied )?warranties
open-source | open source licen | 0.4 | open source licen[cs]es?
free-software | free software licen | 0.4 | free software licen[cs]es?
unnamed-license | file | 0.3 | (?:see|refer to) the (?:accompanying )?(?:license|licence|copying) file
unnamed-license | licen | 0.3 | see licen[cs]e for (?:details|more information)
unnamed-license | licen | 0.2 | licen[cs]ed under
unnamed-license | terms | 0.2 | terms and conditions of (?:the|this) licen[cs]e
"""

#: One of these stems, or of SHORT_WORDS, stands, whatever parts its words, in the text of everything that a rule matches.
STEMS = (
    "licen", "copyright", "rights", "warrant", "domain", "commercial", "confidential", "permission", "published", "distribut", "software", "neither", "released", "available", "provided",
    "fuck", "possible", "invariant", "commons", "cc0", "gpl", "bsd", "cddl", "eupl", "cecill", "odbl", "gfdl", "exception", "wtfpl", "unauthori", "reproduced", "trade", "research", "personal",
    "derivative", "attribution", "terms", "sspl", "polyform", "university", "executable", "consortium", "copying", "openrail",
)
#: Short words, which as parts of others would be too common.
SHORT_WORDS = r"(?<![0-9a-z])(?:cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by|asl|mpl|psl|psf|beer|perl|rail)(?![0-9a-z])"


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, expression, score), in order of priority."""
    found = []
    for i, line in enumerate(RULES_TEXT.strip().split("\n")):
        label, keyword, score, expression = line.split(" | ", 3)
        found.append((i, label, keyword, expression.replace("@", "(?: version)? v? ?"), float(score)))
    return found
