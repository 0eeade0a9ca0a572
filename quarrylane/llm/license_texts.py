"""Hand-written signatures of license texts: what a license says, what a file's notice says, and what licenses are called for short.

A line is a label, a keyword (its longest word is in every match), and a
signature. Between the words of a signature may stand any white space,
punctuation and comment marks, in short names white space or a hyphen; the words
themselves are regular expressions over lower-cased text.
"""

from __future__ import annotations

#: Wording of the licenses themselves.
BODIES = r"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial | the above copyright notice and this permission notice (?:\(?including the next paragraph\)? )?shall be included in all copies or substantial portions of the software
mit | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies
mit | noninfringement | without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | tort | be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so(?!\W+subject)
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | hereby | permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee is hereby granted provided that
isc | disclaims | the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software
0bsd | hereby | permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted(?!\W+provided)
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | holders and contributors | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd | regents | this software is provided by the regents and contributors as is
bsd-3-clause | endorse | neither the names? of .{1,120}? (?:nor|or) the names of (?:its|their) contributors may be used to endorse or promote products
bsd-3-clause | endorse | neither the name of the university nor the names of its contributors may be used to endorse
bsd-3-clause | endorse | the names? of (?:the )?(?:authors?|contributors?|copyright holders?) may not be used to endorse or promote products derived from this software
bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause-views | views | the views and conclusions contained in the software and documentation are those of the authors
apache-2.0 | perpetual | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license
apache-2.0 | litigation | if you institute patent litigation against any entity \(?including a cross-claim or counterclaim in a lawsuit\)? alleging that the work
apache-2.0 | derivative | you must give any other recipients of the work or derivative works a copy of this license
apache-2.0 | notice text file | if the work includes a notice text file as part of its distribution
apache-2.0 | terms and conditions | terms and conditions for use reproduction and distribution
apache-1.1 | apache | this product includes software developed by the apache software foundation
apache-1.1 | apache | the names apache and apache software foundation must not be used to endorse or promote products
apache-1.0 | apache group | this software is provided by the apache group as is
gpl | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl | freedom | the gnu general public license is intended to guarantee your freedom to share and change
gpl-2.0 | verbatim | you may copy and distribute verbatim copies of the program s source code as you receive it
gpl-2.0 | accept this license | you are not required to accept this license since you have not signed it
gpl-2.0 | modified files | you must cause the modified files to carry prominent notices stating that you changed the files
gpl-3.0 | convey | you may convey verbatim copies of the program s source code as you receive it
gpl-3.0 | propagate | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl-3.0 | copyright | all rights granted under this license are granted for the term of copyright on the program
gpl-3.0 | technological measure | no covered work shall be deemed part of an effective technological measure
gpl-3.0 | user product | a user product is either a consumer product which means any tangible personal property
lgpl | designated | this license the lesser general public license applies to some specially designated software packages
lgpl-2.1 | library | a work that uses the library
lgpl-2.1 | library | you may opt to apply the terms of the ordinary gnu general public license instead of this license to a given copy of the library
lgpl-3.0 | combined work | you may convey a combined work under terms of your choice
lgpl-3.0 | incorporates | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl-3.0 | remotely | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3.0 | affero | the gnu affero general public license is designed specifically to ensure
gfdl | invariant | with no invariant sections with no front-cover texts and with no back-cover texts
gfdl | document | the purpose of this license is to make a manual textbook or other functional and useful document free
mpl-1.1 | initial developer | the initial developer hereby grants you a world-wide royalty-free non-exclusive license subject to third party intellectual property claims
mpl-2.0 | intellectual | each contributor hereby grants you a world-wide royalty-free non-exclusive license under intellectual property rights
mpl-2.0 | larger work | you may create and distribute a larger work under terms of your choice provided that you also comply with the requirements of this license for the covered software
mpl-2.0 | covered | covered software is provided under this license on an as is basis without warranty of any kind
epl | accompanying | the accompanying program is provided under the terms of this eclipse public license
epl-2.0 | secondary license | this source code may also be made available under the following secondary licenses
epl-1.0 | agreement steward | the eclipse foundation is the initial agreement steward
cpl-1.0 | common public | the accompanying program is provided under the terms of this common public license
cddl | covered software | any covered software that you distribute or otherwise make available in executable form must also be made available in source code form
cddl-1.0 | microsystems | sun microsystems inc is the initial license steward
eupl | european union public | this european union public licen[cs]e (?:the )?(?:eupl )?applies to the work
artistic-1.0 | artistic control | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | standard version | you are permitted to use the standard version and create and use modified versions for any purpose without restriction
artistic-2.0 | package | this license establishes the terms under which a given free software package may be copied modified distributed and/or redistributed
ofl-1.1 | font | the goals of the open font license \(?ofl\)? are to stimulate worldwide development of collaborative font projects
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font name
ofl-1.1 | font software | neither the font software nor any of its individual components in original or modified versions may be sold by itself
osl-3.0 | external deployment | the term external deployment means the use distribution or communication of the original work
afl-3.0 | academic | licensed under the academic free license version 3 0
ms-pl | grant | the license grants in section 2 each contributor grants you a non-exclusive worldwide royalty-free copyright license to reproduce its contribution
ms-pl | accept the license | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | recipients | for any file you distribute that contains code from the software .{0,60}? you must provide recipients the source code to that file along with a copy of this license
boost-1.0 | machine-executable | must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine-executable object code
boost-1.0 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | held liable | in no event will the authors be held liable for any damages arising from the use of this software
zpl-2.1 | zope | names? of zope (?:corporation|foundation) must not be used to endorse or promote products
psf-2.0 | psf | psf hereby grants licensee a nonexclusive royalty-free world-wide license to reproduce analyze test perform
python-cwi | mathematisch | stichting mathematisch centrum amsterdam the netherlands all rights reserved
postgresql | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | illinois | neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission of the university of illinois
ncsa | deal with | to deal with the software without restriction including without limitation the rights to use
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
curl | stenberg | copyright .{1,80}? daniel stenberg
ntp | university of delaware | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted .{0,120}? university of delaware
hpnd | hereby | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted(?: without fee)? provided that
tcl | authors hereby | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
ruby | verbatim | you may make and give away verbatim copies of the source form of the software without restriction
php-3.01 | php | this product includes php software freely available from
php-3.01 | php | the name php must not be used to endorse or promote products derived from this software
vim | vim | a license agreement between you and the vim maintainer
json | good | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
wtfpl | fuck | you just do what the fuck you want to
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | jurisdictions | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
cc0-1.0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
cc0-1.0 | related rights | to the extent possible under law .{1,80}? has waived all copyright and related or neighbou?ring rights
cc-by | redistribute | you are free to share copy and redistribute the material in any medium or format
cc-by | appropriate | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | modified | if you remix transform or build upon the material you may not distribute the modified material
cc | exercising | by exercising the licensed rights \(?defined below\)? you accept and agree to be bound by the terms and conditions of this creative commons
odbl-1.0 | database | the open database license \(?odbl\)? is a license agreement intended to allow users to freely share modify and use this database
odc-by-1.0 | database | this license agreement .{0,80}? intended to allow users to freely share modify and use this database subject only to the attribution requirements
pddl-1.0 | public domain dedication | the public domain dedication and licen[cs]e is a document intended to allow you to freely share modify and use this work
bsl-1.1 | non-production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non-production use of the licensed work
sspl-1.0 | functionality | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | right to sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
llama | llama | licensed under the (?:meta )?llama \d(?:\.\d)? community license
openrail | derivatives | you agree not to use the model or derivatives of the model in any way that violates
nist | pursuant | pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection
us-government | public domain | this is a work of the united states government and is in the public domain
eula | agreement | this end-?user licen[cs]e agreement eula is a legal agreement between you
eula | reverse engineer | you may not reverse engineer decompile or disassemble the software
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | confidential | proprietary and confidential
proprietary | written permission | no part of this (?:publication|document|book|work) may be reproduced .{0,120}? without (?:the )?(?:prior )?written permission
proprietary | software | this software (?:contains|is) (?:the )?(?:confidential and )?(?:proprietary )?(?:information|trade secrets?) of
"""

#: What a file's header says of its license.
NOTICES = r"""
apache-2.0 | except in compliance | you may not use this file except in compliance with the license
apache-2.0 | as is basis | distributed under the license is distributed on an as is basis
apache | apache | licensed to the apache software foundation \(?asf\)? under one or more contributor license agreements
gpl | free software | this (?:program|software|file|library|package|code|module|script) is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl | redistribute | (?:program|software) you can redistribute it and/or modify it under the terms of the (?:gnu )?(?:gpl|general public licen[cs]e)
gpl | foundation | as published by the free software foundation
gpl | useful | (?:program|software|file|code|package|script) is distributed in the hope that it will be useful but without any warranty
gpl | received a copy | you should have received a copy of the gnu general public licen[cs]e
gpl-2.0 | version 2 | general public licen[cs]e as published by the free software foundation (?:either )?version 2
gpl-3.0 | version 3 | general public licen[cs]e as published by the free software foundation (?:either )?version 3
gpl-2.0 | version 2 | general public licen[cs]e version 2 (?:only|as published|or later)
gpl-3.0 | version 3 | general public licen[cs]e version 3 (?:only|as published|or later)
lgpl | free software | this (?:library|program|software|file) is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl | received a copy | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
lgpl-2.1 | version 2.1 | (?:lesser|library) general public licen[cs]e as published by the free software foundation (?:either )?version 2\.1
agpl | free software | this (?:program|software|file) is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e
agpl | received a copy | you should have received a copy of the gnu affero general public licen[cs]e
agpl-3.0 | version 3 | affero general public licen[cs]e as published by the free software foundation (?:either )?version 3
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license
mpl-1.1 | contents of this file | the contents of this file are subject to the mozilla public license version 1\.1
mpl | mpl | if a copy of the mpl was not distributed with this file you can obtain one
cddl | contents of this file | the contents of this file are subject to the terms of the common development and distribution license
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
bsd | bsd-style | use of this source code is governed by a bsd-style license
mit | governed | use of this source code is governed by an mit-style license
mit | mit | (?:released|licensed|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:permissive )?mit licen[cs]e
mit | mit | licen[cs]e mit
apache-2.0 | apache | licen[cs]e apache(?: software)?(?: licen[cs]e)? 2\.0
gpl-3.0 | gpl | licen[cs]e (?:gnu )?gpl-?v?3
gpl-2.0 | gpl | licen[cs]e (?:gnu )?gpl-?v?2
boost-1.0 | boost | distributed under the boost software license version 1\.0
psf-2.0 | psf | licensed to psf under a contributor agreement
perl | perl | (?:you can redistribute it and/or modify it )?under the same terms as perl itself
ruby | ruby | (?:redistribute|distributed|licensed) .{0,60}?under the same terms as ruby
public-domain | public domain | this (?:file|work|code|program|software|document) (?:is|was|has been) (?:hereby )?(?:placed |released |dedicated )?in(?:to)? the public domain
public-domain | public domain | no copyright is claimed (?:and|this) .{0,60}?public domain
creative-commons | creative commons | (?:this|the) (?:work|text|article|page|content|document|article is|image)s? (?:is|are) (?:licen[cs]ed|available) under (?:a |the )?creative commons
cc-by-sa | share | text is available under the creative commons attribution-?share-?alike licen[cs]e
cc-by-sa-3.0 | contributions | user contributions licensed under cc(?:-wiki| by-sa)
ofl-1.1 | font | this font software is licensed under the sil open font license
wtfpl | fuck | do what the fuck you want to public licen[cs]e
proprietary | reserved | copyright .{1,80}? all rights reserved
"""

#: Short names.
SHORT = r"""
gpl | gpl | (?<!\w)gnu gpl(?!\w)
gpl-1.0 | gpl | (?<![\w-])(?:gnu )?gpl ?-?(?:version |v)?1(?:\.0)?\+?(?![\w.]*\d)
gpl-2.0 | gpl | (?<![\w-])(?:gnu )?gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?(?!\.?\d)
gpl-2.0 | gpl | (?<![\w-])(?:gnu )?gpl (?:version |v)?2(?:\.0)?\+?(?!\.?\d)
gpl-3.0 | gpl | (?<![\w-])(?:gnu )?gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?(?!\.?\d)
gpl-3.0 | gpl | (?<![\w-])(?:gnu )?gpl (?:version |v)?3(?:\.0)?\+?(?!\.?\d)
lgpl | lgpl | (?<!\w)gnu lgpl(?!\w)
lgpl-2.0 | lgpl | (?<![\w-])lgpl-?(?:version |v)?2(?:\.0)?(?:-only|-or-later|\+)?(?!\.?\d)
lgpl-2.1 | lgpl | (?<![\w-])lgpl-?(?:version |v)?2\.1(?:-only|-or-later|\+)?(?!\d)
lgpl-2.1 | lgpl | (?<![\w-])lgpl (?:version |v)?2\.1\+?(?!\d)
lgpl-3.0 | lgpl | (?<![\w-])lgpl-?(?:version |v)?3(?:\.0)?(?:-only|-or-later|\+)?(?!\.?\d)
lgpl-3.0 | lgpl | (?<![\w-])lgpl (?:version |v)?3(?:\.0)?\+?(?!\.?\d)
agpl | agpl | (?<!\w)gnu agpl(?!\w)
agpl-3.0 | agpl | (?<![\w-])agpl-?(?:version |v)?3(?:\.0)?(?:-only|-or-later|\+)?(?!\.?\d)
agpl-3.0 | agpl | (?<![\w-])agpl (?:version |v)?3(?:\.0)?\+?(?!\.?\d)
gfdl | gfdl | (?<!\w)gfdl(?:-?1\.[123])?(?!\w)
mit | mit | (?<![\w-])mit-licen[cs]ed(?!\w)
mit | expat | (?<!\w)expat licen[cs]e(?!\w)
mit | mit | (?<![\w-])mit/x11(?!\w)
apache-2.0 | apache | (?<![\w-])apache-2(?:\.0)?(?!\.?\d)
apache-2.0 | apache | (?<![\w-])apache (?:version |v)?2\.0(?!\.?\d)
apache-2.0 | asl | (?<!\w)asl 2\.0(?!\d)
apache-1.1 | apache | (?<![\w-])apache-1\.1(?!\d)
bsd-2-clause | freebsd | (?<!\w)freebsd licen[cs]e(?!\w)
bsd-2-clause | bsd-2 | (?<!\w)bsd-2(?:-clause)?(?!\w)
bsd-3-clause | bsd-3 | (?<!\w)bsd-3(?:-clause)?(?!\w)
bsd-3-clause | clause bsd | (?<!\w)(?:3|three)-clause bsd(?!\w)
bsd-4-clause | original bsd | (?<!\w)original bsd licen[cs]e(?!\w)
bsd-4-clause | bsd-4 | (?<!\w)bsd-4-clause(?!\w)
mpl-1.1 | mpl | (?<![\w-])mpl(?:-| v?| version )1\.1(?!\d)
mpl-2.0 | mpl | (?<![\w-])mpl(?:-| v?| version )2(?:\.0)?(?!\.?\d)
epl-1.0 | epl | (?<![\w-])epl(?:-| v?)1\.0(?!\d)
epl-2.0 | epl | (?<![\w-])epl(?:-| v?)2\.0(?!\d)
cddl-1.0 | cddl | (?<![\w-])cddl(?:-| v?)1\.0(?!\d)
eupl-1.2 | eupl | (?<![\w-])eupl(?:-| v?)1\.2(?!\d)
osl-3.0 | osl | (?<![\w-])osl(?:-| v?)3\.0(?!\d)
afl-3.0 | afl | (?<![\w-])afl(?:-| v?)3\.0(?!\d)
ofl-1.1 | ofl | (?<![\w-])(?:sil )?ofl(?:-| v?)1\.1(?!\d)
boost-1.0 | bsl | (?<![\w-])bsl-1\.0(?!\d)
cc0-1.0 | cc0 | (?<!\w)cc0(?:-| )1\.0(?!\d)
cc-by-4.0 | cc | (?<!\w)cc[- ]by[- ]4\.0(?!\d)
cc-by-3.0 | cc | (?<!\w)cc[- ]by[- ]3\.0(?!\d)
cc-by-sa-4.0 | cc | (?<!\w)cc[- ]by[- ]sa[- ]4\.0(?!\d)
cc-by-sa-3.0 | cc | (?<!\w)cc[- ]by[- ]sa[- ]3\.0(?!\d)
cc-by-nc-4.0 | cc | (?<!\w)cc[- ]by[- ]nc[- ]4\.0(?!\d)
cc-by-nc-sa-4.0 | cc | (?<!\w)cc[- ]by[- ]nc[- ]sa[- ]4\.0(?!\d)
cc-by-nd-4.0 | cc | (?<!\w)cc[- ]by[- ]nd[- ]4\.0(?!\d)
openrail | rail | (?<!\w)(?:creativeml )?open ?rail(?:-m)?(?: licen[cs]e)?(?!\w)
ms-pl | ms-pl | (?<!\w)ms-pl(?!\w)
ms-rl | ms-rl | (?<!\w)ms-rl(?!\w)
gpl-exception | exception | (?<!\w)(?:gcc runtime library|classpath|linking|bison|font) exception(?!\w)
dual | dual | (?<!\w)dual[- ]licen[cs]ed(?!\w)
copyleft | copyleft | (?<!\w)copyleft(?: licen[cs]e)?(?!\w)
"""
