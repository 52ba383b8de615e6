"""Signatures of licenses, in order of priority, over lower-case words parted by single spaces.

A line is a label and a regular expression; a space in it is a step to the next word. Punctuation parts words, so
"GPL-3.0" is three words. The kinds come in order of priority; ``WEIGHT`` is how sure a kind is.
"""

from __future__ import annotations

import re

TAG, TEXT, NOTICE, NAME, HINT = range(5)
WEIGHT = {TAG: 1.0, TEXT: 0.95, NOTICE: 0.9, NAME: 0.75, HINT: 0.4}

#: phrases whose every place is reported, whatever else covers it
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: identifiers after "SPDX-License-Identifier:"; one tag rule each
SPDX = """
0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0
bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0
cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1
cecill-b cecill-c cpl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0
gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0
ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0 tcl unicode-dfs-2016
unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split()

RULES = {
    # sentences that stand in the licenses themselves
    TEXT: """
mit             permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit             the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0           permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400} sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc             permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd            permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: without fee)? is hereby granted
ntp             permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsd             redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause    redistributions in binary form must reproduce the above copyright notice
bsd-3-clause    neither the names? of .{1,160} nor the names of (?:its|their|any)(?: other)? contributors may be used to endorse or promote products derived from this software without(?: specific)?(?: prior)? written permission
bsd-4-clause    above copyright notice .{0,400} all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear  no express or implied licenses to any party s patent rights are granted by this license
apache-2.0      unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0      you may not use this file except in compliance with the license
apache-2.0      see the license for the specific language governing permissions and limitations under the license
apache-2.0      apache org licenses terms and conditions for use reproduction and distribution
apache-1.1      this product includes software developed by the apache software foundation
gpl             everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl             this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0         gnu general public license(?: as published by the free software foundation)? either version 2
gpl-2.0         gnu general public license version 2 june 1991
gpl-3.0         gnu general public license(?: as published by the free software foundation)? either version 3
gpl-3.0         gnu general public license version 3 29 june 2007
gpl             you should have received a copy of the gnu general public license along with this program
lgpl            this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1        gnu lesser general public license(?: as published by the free software foundation)? either version 2 1
lgpl-2.1        gnu lesser general public license version 2 1 february 1999
lgpl-3.0        gnu lesser general public license(?: as published by the free software foundation)? either version 3
lgpl-2.0        gnu library general public license version 2 june 1991
agpl-3.0        gnu affero general public license(?: as published by the free software foundation)? either version 3
agpl-3.0        gnu affero general public license version 3 19 november 2007
gfdl            permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl            with no invariant sections no front cover texts and no back cover texts a copy of the license
mpl-1.1         the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0         this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0         if a copy of the mpl was not distributed with this file you can obtain one at .{0,40}mozilla org mpl 2 0(?: and this license)?
epl-1.0         the accompanying program is provided under the terms of this eclipse public license
epl-2.0         this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
cddl-1.0        the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0         permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib            this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng          the png reference library is supplied as is .{0,200} disclaim all warranties
python-2.0      subject to the terms and conditions of this license agreement psf hereby grants licensee
unlicense       this is free and unencumbered software released into the public domain
unlicense       anyone is free to copy modify publish use compile sell or distribute this software .{0,400} copyright
cc0-1.0         to the extent possible under law .{1,120} waived all copyright and related or neighboring rights
wtfpl           everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl           you just do what the fuck you want to public license
artistic-2.0    this license establishes the terms under which a given free software package may be copied modified distributed
artistic-1.0    the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains
ofl-1.1         this font software is licensed under the sil open font license version 1 1
ofl-1.1         the fonts and derivatives however cannot be released under any other type of license
eupl-1.2        licensed under the eupl version 1 2 or as soon they will be approved by the european commission
eupl-1.1        licensed under the eupl version 1 1 or as soon they will be approved by the european commission
ms-pl           this license governs use of the accompanying software if you use the software you accept this license
osl-3.0         licensed under the open software license version 3 0
afl-3.0         licensed under the academic free license version 3 0
ecl-2.0         licensed under the educational community license version 2 0
ncsa            developed by .{1,120} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
postgresql      permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
tcl             the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
w3c             this work is being provided by the copyright holders under the following license
beerware        beer ware license .{0,300} as long as you retain this notice you can do whatever you want with this stuff
json            the software shall be used for good not evil the copyright .{0,40}permission
sspl-1.0        if you make the functionality of the program .{0,60} as a service you must make the service source code available .{0,80} license
busl-1.1        the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0     you may not provide the software to third parties as a hosted or managed service .{0,200} license
unicode         permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
vim             the vim editor .{0,80} gpl compatible license
mulanpsl-2.0    is licensed under mulan psl v2
proprietary     unauthori[sz]ed copying of this file via any medium is strictly prohibited.{0,60} copyright
proprietary     this software is the confidential and proprietary information of .{1,80} license agreement
""",
    # statements that a work is under a license
    NOTICE: """
mit             LICENSED the (?:mit|expat|x11)(?: x11)? licen[cs]e
mit             dual licensed under the mit
apache-2.0      LICENSED the apache licen[cs]e(?: version)? v?2(?: 0)?
apache-2.0      LICENSED apache 2(?: 0)?
apache-1.1      LICENSED the apache software licen[cs]e(?: version)? 1 1
apache          LICENSED the apache(?: software)? licen[cs]e
gpl-1.0         LICENSED the gnu general public licen[cs]e(?: as published by the free software foundation)?(?: version)? v?1(?: 0)?
gpl-2.0         LICENSED the(?: gnu)? (?:general public licen[cs]e|gpl)(?: gpl)?(?: version)? v?2(?: 0)?
gpl-3.0         LICENSED the(?: gnu)? (?:general public licen[cs]e|gpl)(?: gpl)?(?: version)? v?3(?: 0)?
gpl             LICENSED the(?: gnu)? (?:general public licen[cs]e|gpl)
lgpl-2.1        LICENSED the(?: gnu)? (?:(?:lesser|library) general public licen[cs]e|lgpl)(?: lgpl)?(?: version)? v?2 1
lgpl-3.0        LICENSED the(?: gnu)? (?:(?:lesser|library) general public licen[cs]e|lgpl)(?: lgpl)?(?: version)? v?3(?: 0)?
lgpl            LICENSED the(?: gnu)? (?:(?:lesser|library) general public licen[cs]e|lgpl)
agpl-3.0        LICENSED the(?: gnu)? (?:affero general public licen[cs]e|agpl)(?: agpl)?(?: version)? v?3(?: 0)?
agpl            LICENSED the(?: gnu)? (?:affero general public licen[cs]e|agpl)
gfdl            LICENSED the(?: gnu)? free documentation licen[cs]e
bsd-2-clause    LICENSED the (?:(?:2|two) clause|simplified) bsd(?: licen[cs]e)?
bsd-3-clause    LICENSED the (?:(?:3|three) clause|new|modified|revised) bsd(?: licen[cs]e)?
bsd-4-clause    LICENSED the (?:(?:4|four) clause|original|old) bsd(?: licen[cs]e)?
bsd-2-clause    LICENSED the bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause    LICENSED the bsd (?:3|three) clause(?: licen[cs]e)?
bsd             LICENSED (?:the|a) bsd(?: style)?(?: licen[cs]e)?
mpl-1.1         LICENSED the (?:mozilla public licen[cs]e|mpl)(?: version)? v?1 1
mpl-2.0         LICENSED the (?:mozilla public licen[cs]e|mpl)(?: version)? v?2(?: 0)?
mpl             LICENSED the (?:mozilla public licen[cs]e|mpl)
epl-1.0         LICENSED the (?:eclipse public licen[cs]e|epl)(?: version)? v?1(?: 0)?
epl-2.0         LICENSED the (?:eclipse public licen[cs]e|epl)(?: version)? v?2(?: 0)?
epl             LICENSED the (?:eclipse public licen[cs]e|epl)
eupl            LICENSED the (?:european union public licen[cs]e|eupl)
cddl            LICENSED the (?:common development and distribution licen[cs]e|cddl)
cpl             LICENSED the common public licen[cs]e
isc             LICENSED the isc(?: licen[cs]e)?
zlib            LICENSED the zlib(?: libpng)?(?: licen[cs]e)?
bsl-1.0         LICENSED the boost software licen[cs]e
unlicense       LICENSED the unlicense
artistic-2.0    LICENSED the artistic licen[cs]e(?: version)? v?2(?: 0)?
artistic        LICENSED the artistic licen[cs]e
perl            LICENSED the same terms as perl
python-2.0      LICENSED the (?:python|psf)(?: software foundation)? licen[cs]e
ruby            LICENSED the same terms as ruby
ofl-1.1         LICENSED the (?:sil )?open font licen[cs]e
ms-pl           LICENSED the microsoft public licen[cs]e
ms-rl           LICENSED the microsoft reciprocal licen[cs]e
osl             LICENSED the open software licen[cs]e
afl             LICENSED the academic free licen[cs]e
wtfpl           LICENSED the wtfpl
lppl            LICENSED the latex project public licen[cs]e
cecill          LICENSED the cecill
postgresql      LICENSED the postgresql licen[cs]e
php             LICENSED the php licen[cs]e
sspl-1.0        LICENSED the server side public licen[cs]e
busl            LICENSED the business source licen[cs]e
elastic         LICENSED the elastic licen[cs]e
odbl            LICENSED the open (?:data commons open )?database licen[cs]e
cc-by           LICENSED (?:a|the) creative commons attribution(?: [1-4] [0-9])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa        LICENSED (?:a|the) creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc        LICENSED (?:a|the) creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd        LICENSED (?:a|the) creative commons attribution no ?deriv(?:ative|ativework)?s?(?: [1-4] [0-9])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-sa     LICENSED (?:a|the) creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd     LICENSED (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative|ativework)?s?(?: [1-4] [0-9])?(?: international| unported)?(?: licen[cs]e)?
cc              LICENSED (?:a|the) creative commons licen[cs]e
cc-by           LICENSED cc by(?: [1-4] [0-9])?
cc-by-sa        LICENSED cc by sa(?: [1-4] [0-9])?
cc-by-nc        LICENSED cc by nc(?: [1-4] [0-9])?
cc-by-nd        LICENSED cc by nd(?: [1-4] [0-9])?
cc-by-nc-sa     LICENSED cc by nc sa(?: [1-4] [0-9])?
cc-by-nc-nd     LICENSED cc by nc nd(?: [1-4] [0-9])?
cc0-1.0         LICENSED cc0(?: 1 0)?
public-domain   (?:released|dedicated|placed|put) (?:in|to|into) the public domain
public-domain   (?:this|the) (?:work|code|file|software|text|document|program) is (?:in the )?public domain
proprietary     licensed (?:material|materials) property of ibm
""",
    # names and addresses
    NAME: """
mit             mit license
mit             mit licen[cs]e
mit             expat licen[cs]e
mit             x11 licen[cs]e
mit             opensource org licenses mit(?: license)?
mit-0           mit no attribution licen[cs]e
apache          apache license
apache          apache(?: software)? licen[cs]e
apache-2.0      apache(?: software)? licen[cs]e v?2(?: 0)?
apache-2.0      apache(?: software)? licen[cs]e version 2(?: 0)?
apache-2.0      www apache org licenses license 2 0
apache-2.0      apache org licenses license 2 0
apache-2.0      opensource org licenses apache 2 0
apache-2.0      apache 2 0
apache-2.0      asl 2 0 licen[cs]e
apache-1.1      apache(?: software)? licen[cs]e(?: version)? v?1 1
apache-1.0      apache(?: software)? licen[cs]e(?: version)? v?1 0
gpl             general public license
gpl             gnu general public licen[cs]e
gpl-1.0         gnu general public licen[cs]e(?: version)? v?1(?: 0)?
gpl-2.0         gnu general public licen[cs]e(?: version)? v?2(?: 0)?
gpl-3.0         gnu general public licen[cs]e(?: version)? v?3(?: 0)?
gpl-2.0         gnu gpl(?: version)? v?2(?: 0)?
gpl-3.0         gnu gpl(?: version)? v?3(?: 0)?
gpl             gnu gpl
gpl-2.0         gpl(?: version)? v?2(?: 0)?
gpl-3.0         gpl(?: version)? v?3(?: 0)?
gpl-2.0         gplv2
gpl-3.0         gplv3
gpl-2.0         gnu org licenses(?: old licenses)? gpl 2 0
gpl-3.0         gnu org licenses gpl 3 0
gpl             gnu org (?:licenses|copyleft) gpl(?: html)?
gpl             opensource org licenses gpl(?: license)?
lgpl            (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl-2.0        (?:gnu )?library general public licen[cs]e(?: version)? v?2(?: 0)?
lgpl-2.1        (?:gnu )?lesser general public licen[cs]e(?: version)? v?2 1
lgpl-3.0        (?:gnu )?lesser general public licen[cs]e(?: version)? v?3(?: 0)?
lgpl-2.1        (?:gnu )?lgpl(?: version)? v?2 1
lgpl-3.0        (?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgpl            gnu lgpl
lgpl-2.1        lgplv2 1
lgpl-3.0        lgplv3
lgpl            gnu org (?:licenses|copyleft) lgpl(?: html)?
agpl            (?:gnu )?affero general public licen[cs]e
agpl-3.0        (?:gnu )?affero general public licen[cs]e(?: version)? v?3(?: 0)?
agpl-3.0        (?:gnu )?agpl(?: version)? v?3(?: 0)?
agpl-3.0        agplv3
agpl            gnu org licenses agpl(?: 3 0)?
gfdl            gnu free documentation licen[cs]e
gfdl-1.2        gnu free documentation licen[cs]e(?: version)? 1 2
gfdl-1.3        gnu free documentation licen[cs]e(?: version)? 1 3
gfdl            gnu org licenses fdl(?: 1 [1-3])?(?: html)?
bsd             bsd(?: style)? licen[cs]e
bsd-2-clause    (?:2|two) clause bsd licen[cs]e
bsd-3-clause    (?:3|three) clause bsd licen[cs]e
bsd-4-clause    (?:4|four) clause bsd licen[cs]e
bsd-2-clause    simplified bsd licen[cs]e
bsd-3-clause    (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause    freebsd licen[cs]e
bsd-2-clause    bsd (?:2|two) clause(?: simplified)? licen[cs]e
bsd-3-clause    bsd (?:3|three) clause(?: new| revised| modified)? licen[cs]e
bsd-2-clause    opensource org licenses bsd 2 clause
bsd-3-clause    opensource org licenses bsd 3 clause
bsd             opensource org licenses bsd(?: license)?
0bsd            zero clause bsd licen[cs]e
mpl             mozilla public licen[cs]e
mpl-1.0         mozilla public licen[cs]e(?: version)? v?1 0
mpl-1.1         mozilla public licen[cs]e(?: version)? v?1 1
mpl-2.0         mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl-2.0         mozilla org mpl 2 0
mpl             mozilla org mpl
npl             netscape public licen[cs]e
epl             eclipse public licen[cs]e
epl-1.0         eclipse public licen[cs]e(?: version)? v?1(?: 0)?
epl-2.0         eclipse public licen[cs]e(?: version)? v?2(?: 0)?
edl-1.0         eclipse distribution licen[cs]e
cpl-1.0         common public licen[cs]e(?: version)? v?1(?: 0)?
ipl-1.0         ibm public licen[cs]e
cddl            common development and distribution licen[cs]e
cddl-1.0        common development and distribution licen[cs]e(?: cddl)?(?: version)? v?1 0
cddl-1.1        common development and distribution licen[cs]e(?: cddl)?(?: version)? v?1 1
eupl            european union public licen[cs]e
eupl-1.1        european union public licen[cs]e(?: version)? v ?1 1
eupl-1.2        european union public licen[cs]e(?: version)? v ?1 2
isc             isc licen[cs]e
zlib            zlib(?: libpng)? licen[cs]e
libpng          libpng licen[cs]e
bsl-1.0         boost software licen[cs]e
bsl-1.0         boost org license 1 0
unlicense       unlicense org
unlicense       the unlicense
wtfpl           do what the fuck you want to public licen[cs]e
beerware        beer ?ware licen[cs]e
artistic        artistic licen[cs]e
artistic-1.0    artistic licen[cs]e(?: version)? v?1(?: 0)?
artistic-2.0    artistic licen[cs]e(?: version)? v?2(?: 0)?
perl            perl artistic licen[cs]e
python-2.0      python software foundation licen[cs]e
python-2.0      psf licen[cs]e
cnri            cnri python licen[cs]e
php             php licen[cs]e
php-3.01        php licen[cs]e(?: version)? v?3 01
ruby            ruby licen[cs]e
ofl-1.1         sil open font licen[cs]e
ofl-1.1         openfontlicense org
ms-pl           microsoft public licen[cs]e
ms-rl           microsoft reciprocal licen[cs]e
osl             open software licen[cs]e
osl-3.0         open software licen[cs]e(?: version)? v?3(?: 0)?
afl             academic free licen[cs]e
afl-2.1         academic free licen[cs]e(?: version)? v?2 1
afl-3.0         academic free licen[cs]e(?: version)? v?3(?: 0)?
ecl             educational community licen[cs]e
lppl            latex project public licen[cs]e
lppl-1.3c       latex project public licen[cs]e(?: version)? 1 3c?
cecill          cecill licen[cs]e
cecill-b        cecill b licen[cs]e
cecill-c        cecill c licen[cs]e
postgresql      postgresql licen[cs]e
openssl         openssl licen[cs]e
ncsa            ncsa open source licen[cs]e
ncsa            university of illinois ncsa open source licen[cs]e
tcl             tcl tk licen[cs]e
vim             vim licen[cs]e
w3c             w3c software(?: and document)?(?: notice and)? licen[cs]e
unicode         unicode(?: data files)? licen[cs]e(?: agreement)?
icu             icu licen[cs]e
json            json licen[cs]e
sspl-1.0        server side public licen[cs]e
busl-1.1        business source licen[cs]e
elastic-2.0     elastic licen[cs]e(?: version)? v?2(?: 0)?
upl-1.0         universal permissive licen[cs]e
mulanpsl-2.0    mulan permissive software licen[cs]e
apsl            apple public source licen[cs]e
zpl             zope public licen[cs]e
spl             sun public licen[cs]e
qpl             q public licen[cs]e
sleepycat       sleepycat licen[cs]e
odbl            open database licen[cs]e
odc-by          open data commons attribution licen[cs]e
pddl            open data commons public domain dedication and licen[cs]e
ogl-uk          open government licen[cs]e(?: version)?(?: v?[1-3] 0)?
etalab          licence ouverte etalab
fal             free art licen[cs]e
cc              creative commons licen[cs]e
cc              creativecommons org licenses
cc-by           creativecommons org licenses by [1-4] [0-9]
cc-by-sa        creativecommons org licenses by sa [1-4] [0-9]
cc-by-nc        creativecommons org licenses by nc [1-4] [0-9]
cc-by-nd        creativecommons org licenses by nd [1-4] [0-9]
cc-by-nc-sa     creativecommons org licenses by nc sa [1-4] [0-9]
cc-by-nc-nd     creativecommons org licenses by nc nd [1-4] [0-9]
cc0-1.0         creativecommons org publicdomain zero 1 0
public-domain   creativecommons org publicdomain mark 1 0
cc-by           creative commons attribution(?: [1-4] [0-9])?(?: international)? licen[cs]e
cc-by-sa        creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international)? licen[cs]e
cc-by-nc        creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: international)? licen[cs]e
cc0-1.0         creative commons zero(?: [v1 0]{1,5})?
cc0-1.0         cc0 1 0 universal licen[cs]e
cc0-1.0         cc0 1 0 universal public domain dedication
openrail        openrail(?: m)? licen[cs]e
openrail        responsible ai licen[cs]e
llama           llama [2-4](?: [0-9])? community licen[cs]e
""",
    # words that only suggest terms
    HINT: """
unknown         licensed under the terms of the
unknown         see(?: the)?(?: file)? license(?: txt| md)?(?: file)? for(?: more| the| full)? (?:details|information|terms)
unknown         subject to the (?:following )?(?:terms of the )?license
unknown         license agreement
unknown         open source licen[cs]e
unknown         free software licen[cs]e
unknown         permissive licen[cs]e
unknown         copyleft licen[cs]e
unknown         end user licen[cs]e agreement
proprietary     copyright .{1,80} all rights reserved
""",
}

UNDER = r"(?: to you)? under(?: the)?(?: terms(?: and conditions)?| conditions)?(?: of)?(?: the| an?)?"
VERBS = "licen[cs]ed|released|distributed|available|provided|published|covered|governed|redistributed|used|shared|offered"

#: stems, one of which is in every text that a rule matches
ANCHORS = ["licen", "gpl", "copyright", "permi", "apache", "mozilla", "commons", "public", "warrant"]


def rules() -> list[dict]:
    """Rules in order: ``rule`` (its place), ``kind``, ``label``, ``base``, ``weight``, ``words`` (the expression)."""
    lines = [(TAG, i, "spdx license identifier " + re.sub("[^0-9a-z]+", " ", i)) for i in SPDX]
    for kind, text in RULES.items():
        lines += [(kind, *line.split(None, 1)) for line in text.strip().splitlines()]
    return [{"rule": i, "kind": k, "label": label, "base": k == NAME and (label, w) in BASE, "weight": WEIGHT[k], "words": _notice(w)}
            for i, (k, label, w) in enumerate(lines)]


def _notice(words: str) -> str:
    """LICENSED, with the article after it or without, stands for the verbs of a notice; names that tell by
    themselves of no license take "licensed" alone."""
    name = re.sub(r"^LICENSED(?: the| \(\?:a\|the\)| \(\?:the\|a\))?", "", words)
    if name == words:
        return words
    return (f"(?:{VERBS})" if anchor(name) else "licen[cs]ed") + UNDER + name


def _outside(words: str) -> str:
    """The expression with all that stands in groups, and brackets, blotted out."""
    flat, depth = [], 0
    for c in words.replace(" ?", "#"):
        depth += c in "(["
        flat.append("#" if depth else c)
        depth -= c in ")]"
    return "".join(flat)


def required(words: str) -> list[str]:
    """Whole words that every match holds: plain ones outside groups."""
    return [w for w in _outside(words).split(" ") if re.fullmatch("[a-z0-9]+", w)]


def anchor(words: str) -> str | None:
    """A stem that every match holds."""
    flat = _outside(words)
    return next((a for a in ANCHORS if re.search(re.escape(a) + r"(?![?*{])", flat)), None)


def compiled(words: str) -> str:
    """The expression over text in which each word is written " word:place "; so a space steps over the place, and
    may do so or not before a question mark. Any character but a line feed stands for a dot."""
    step = r":[0-9]+  "
    return " " + words.replace(".{", r"[^\x0A]{").replace(" ?", "\0").replace(" ", step).replace("\0", f"(?:{step})?") + r":[0-9]+ "
