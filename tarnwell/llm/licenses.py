"""License scan: ordered signature rules behind keyword gates, with containment suppression.  DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import let, running, words

#: Phrases of the contract and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keyword that a text must hold, and the name's pattern over lower-cased words (fixed values).
FAMILIES = [
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version )?v?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version )?v?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e"),
    ("x11", "x11 licen", r"x11 licen[cs]e"),
    ("isc", "isc licen", r"isc licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version)? v?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("gpl-any", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("cpl", "common public", r"common public licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("psf", "python software", r"python software foundation licen[cs]e"),
    ("php", "php licen", r"php licen[cs]e"),
    ("ruby", "ruby licen", r"ruby licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want to public licen", r"do what the fuck you want to public licen[cs]e"),
    ("ofl-1.1", "open font licen", r"(?:sil )?open font licen[cs]e"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e"),
    ("odc-by", "data commons", r"open data commons attribution licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("sspl", "server side", r"server side public licen[cs]e"),
    ("busl", "business source", r"business source licen[cs]e"),
    ("elastic", "elastic licen", r"elastic licen[cs]e"),
    ("commons-clause", "commons clause", r"commons clause"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: version)? v?3(?: 0)?"),
    ("afl", "academic free", r"academic free licen[cs]e"),
    ("osl-3.0", "open software licen", r"open software licen[cs]e(?: version)? v?3(?: 0)?"),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e(?: version)? v?2(?: 0)?"),
    ("ecl", "educational community", r"educational community licen[cs]e"),
    ("ncsa", "illinois", r"university of illinois ncsa open source licen[cs]e"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e(?: version)? ?v?(?:1 0)?"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("zpl", "zope", r"zope public licen[cs]e(?: version)?(?: 2 [01])?"),
    ("w3c", "w3c", r"w3c software (?:notice and )?(?:and document )?licen[cs]e"),
    ("vim", "vim licen", r"vim licen[cs]e"),
    ("curl", "curl licen", r"curl licen[cs]e"),
    ("ijg", "independent jpeg", r"independent jpeg group licen[cs]e"),
    ("libpng", "libpng licen", r"libpng licen[cs]e(?: version)?(?: 2)?"),
    ("libtiff", "libtiff licen", r"libtiff licen[cs]e"),
    ("beerware", "beer ware", r"beer ware licen[cs]e"),
    ("bzip2", "bzip2 licen", r"bzip2 licen[cs]e"),
    ("tcl", "tcl tk", r"tcl tk licen[cs]e"),
    ("json", "json licen", r"json licen[cs]e"),
    ("icu", "icu licen", r"icu licen[cs]e"),
    ("unicode", "unicode", r"unicode (?:terms of use|licen[cs]e(?: v3)?)"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("naumen", "naumen", r"naumen public licen[cs]e"),
    ("nasa", "nasa", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("qpl", "q public", r"q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e(?: version)?(?: 1 [15])?"),
    ("rpsl", "realnetworks", r"realnetworks public source licen[cs]e"),
    ("apsl", "apple public", r"apple public source licen[cs]e(?: version)?(?: [12] [0-2])?"),
    ("ipl", "ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("spl", "sun public", r"sun public licen[cs]e(?: version)?(?: 1 0)?"),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e"),
    ("npl", "netscape", r"netscape public licen[cs]e(?: version)?(?: 1 [01])?"),
    ("lppl", "latex project", r"latex project public licen[cs]e(?: version)?(?: 1 [0-3]c?)?"),
    ("cecill-b", "cecill", r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", "cecill", r"cecill c(?: licen[cs]e)?"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl) ?(?:licen[cs]e)?(?: v2| version 2)?"),
    ("miros", "miros", r"miros licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("intel", "intel open", r"intel open source licen[cs]e"),
    ("watcom", "watcom", r"(?:sybase )?open watcom public licen[cs]e"),
    ("nokia", "nokia", r"nokia open source licen[cs]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[cs]e"),
    ("lucent", "lucent", r"lucent public licen[cs]e(?: version)?(?: 1 0[02]?)?"),
    ("entessa", "entessa", r"entessa public licen[cs]e"),
    ("frameworx", "frameworx", r"frameworx open licen[cs]e"),
    ("eiffel", "eiffel", r"eiffel forum licen[cs]e(?: version)?(?: [12])?"),
    ("condor", "condor public", r"condor public licen[cs]e"),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e"),
    ("cua", "cua office", r"cua office public licen[cs]e"),
    ("fair", "fair licen", r"fair licen[cs]e"),
    ("simple-public", "simple public", r"simple public licen[cs]e"),
    ("liliq", "libre du qu", r"licence libre du qu\S+"),
    ("ogl", "open government", r"(?:uk )?open government licen[cs]e(?: v?[1-3](?: 0)?)?"),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?(?: etalab)?(?: 2 0)?"),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("cdla-permissive", "community data", r"community data licen[cs]e agreement permissive(?: 1 0| 2 0)?"),
    ("cdla-sharing", "community data", r"community data licen[cs]e agreement sharing(?: 1 0)?"),
    ("free-art", "free art", r"free art licen[cs]e(?: 1 3)?"),
    ("openrail", "rail", r"(?:bigscience|creativeml)? ?open ?rail(?: m| [a-z])?(?: licen[cs]e)?"),
    ("llama", "llama", r"llama (?:2|3|3 1|3 2|4)? ?community licen[cs]e(?: agreement)?"),
    ("polyform-nc", "polyform", r"polyform noncommercial licen[cs]e(?: 1 0 0)?"),
    ("polyform-sb", "polyform", r"polyform small business licen[cs]e(?: 1 0 0)?"),
    ("polyform-shield", "polyform", r"polyform (?:shield|strict|perimeter) licen[cs]e(?: 1 0 0)?"),
    ("confluent", "confluent", r"confluent community licen[cs]e(?: agreement)?"),
    ("timescale", "timescale", r"timescale licen[cs]e(?: agreement)?"),
    ("rsal", "redis source", r"redis source available licen[cs]e(?: agreement)?"),
    ("fsl", "functional source", r"functional source licen[cs]e(?: version)?(?: 1 [01])?"),
    ("parity", "parity public", r"(?:the )?parity public licen[cs]e(?: [5-7] 0 0)?"),
    ("prosperity", "prosperity public", r"(?:the )?prosperity public licen[cs]e(?: [23] 0 0)?"),
    ("blue-oak", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e(?: [123] [012])?"),
    ("cern-ohl", "cern open", r"cern open hardware licen[cs]e(?: version)?(?: 2| 1 2)?(?: permissive| weakly reciprocal| strongly reciprocal)?"),
    ("tapr", "tapr", r"tapr open hardware licen[cs]e"),
    ("solderpad", "solderpad", r"solderpad hardware licen[cs]e"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?"),
    ("bitstream", "bitstream vera", r"bitstream vera(?: fonts?)? (?:copyright|licen[cs]e)"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv\w+(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-4.0", "4 0", r"(?:cc by|creative commons attribution) 4 0"),
    ("cc-any", "creative commons", r"creative commons(?: attribution)?(?: licen[cs]e)?"),
]
#: What may stand around a name: (level, part of the rule's name, pattern).  A lower level outranks a higher one.
FRAMES = [
    (1, "tag", r"spdx licen[cs]e identifier (?:{0})"),
    (2, "grant", r"(?:licen[cs]ed|released|distributed|published|provided|made available|available|offered|issued) (?:to you )?under (?:the )?(?:terms of )?(?:the |a )?(?:gnu )?(?:{0})"),
    (2, "subject", r"(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{0})"),
    (2, "file", r"(?:see|read) the (?:{0})(?: for)?(?: more)? details"),
    (3, "name", r"(?:{0})"),
]
#: Notices that are known by their wording (level, label, keyword, pattern; fixed values).
NOTICES = [
    (1, "mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    (1, "isc", "and or distribute", r"permission to use copy modify and or distribute this software for any purpose"),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd-3-clause", "endorse", r"neither the name of (?:\w+ ){1,8}nor the names of its contributors may be used to endorse"),
    (1, "apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    (1, "gpl-any", "free software", r"this (?:program|library|file) is free software you can redistribute it and or modify it"),
    (1, "gpl-any", "warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    (1, "mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    (1, "bsl-1.0", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    (1, "zlib", "provided as is", r"this software is provided as is without any express or implied warranty"),
    (1, "unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    (1, "cc-any", "creative commons", r"this work is licen[cs]ed under (?:a|the) creative commons"),
    (1, "mit", "sell copies", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    (1, "mit", "substantial portions", r"(?:the above|this) copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    (1, "mit", "liable for any claim", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    (1, "mit-0", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:\w+ ){4,40}so"),
    (1, "x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    (1, "isc", "with or without fee", r"for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (1, "isc", "author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    (1, "bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (1, "bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (1, "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, "bsd", "copyright holders and contributors", r"this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties"),
    (1, "bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    (1, "0bsd", "for any purpose with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    (1, "apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (1, "apache-2.0", "apache org licenses", r"(?:http )?(?:www )?apache org licenses license 2 0"),
    (1, "apache-2.0", "contributor license", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    (1, "apache-1.1", "apache group", r"this product includes software developed by the apache (?:group|software foundation)"),
    (1, "gpl-any", "free software foundation", r"as published by the free software foundation either version (?:1|2|3|2 1) of the license or at your option any later version"),
    (1, "gpl-2.0", "51 franklin", r"write to the free software foundation inc 51 franklin st(?:reet)? fifth floor boston ma"),
    (1, "gpl-2.0", "59 temple", r"write to the free software foundation inc 59 temple place suite 330 boston ma"),
    (1, "gpl-3.0", "gnu org licenses", r"you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|file|software)(?: if not see)?"),
    (1, "gpl-any", "distributed in the hope", r"(?:program|library|file|software) is distributed in the hope that it will be useful but without any warranty"),
    (1, "gpl-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    (1, "classpath-exception", "classpath", r"(?:with )?(?:the )?classpath exception"),
    (1, "gcc-exception", "runtime library exception", r"gcc runtime library exception(?: version)?(?: 3 1)?"),
    (1, "llvm-exception", "llvm", r"(?:with )?llvm exceptions?"),
    (1, "agpl", "over a network", r"interacting with it remotely through a computer network"),
    (1, "mpl-1.1", "npl or gpl", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]"),
    (1, "mpl-2.0", "mozilla org mpl", r"you can obtain one at (?:http )?mozilla org mpl 2 0"),
    (1, "mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licenses"),
    (1, "epl-2.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20|v10)"),
    (1, "epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    (1, "cddl", "cddl header", r"cddl header (?:start|end)"),
    (1, "cddl", "covered software", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    (1, "zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (1, "zlib", "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (1, "bsl-1.0", "license 1 0 txt", r"(?:accompanying file )?license 1 0 txt or copy at (?:https? )?(?:www )?boost org license 1 0 txt"),
    (1, "unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    (1, "wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    (1, "beerware", "buy me a beer", r"you can buy me a beer in return"),
    (1, "json", "not evil", r"the software shall be used for good not evil"),
    (1, "artistic", "standard version", r"the intent of this document is to state the conditions under which a package may be copied"),
    (1, "perl", "same terms as perl", r"(?:under|on) the same terms as perl(?: 5| itself)?"),
    (1, "ruby", "same terms as ruby", r"(?:under|on) the same terms as ruby(?: itself)?"),
    (1, "openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    (1, "ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    (1, "postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (1, "ofl-1.1", "reserved font name", r"with reserved font names?"),
    (1, "ofl-1.1", "font software", r"this font software is licensed under the sil open font licen[cs]e"),
    (1, "cc-by-4.0", "creativecommons org", r"(?:https? )?creativecommons org licenses by 4 0"),
    (1, "cc-by-3.0", "creativecommons org", r"(?:https? )?creativecommons org licenses by 3 0"),
    (1, "cc-by-sa", "creativecommons org", r"(?:https? )?creativecommons org licenses by sa [1-4] [05]"),
    (1, "cc-by-nc", "creativecommons org", r"(?:https? )?creativecommons org licenses by nc [1-4] [05]"),
    (1, "cc-by-nd", "creativecommons org", r"(?:https? )?creativecommons org licenses by nd [1-4] [05]"),
    (1, "cc-by-nc-sa", "creativecommons org", r"(?:https? )?creativecommons org licenses by nc sa [1-4] [05]"),
    (1, "cc-by-nc-nd", "creativecommons org", r"(?:https? )?creativecommons org licenses by nc nd [1-4] [05]"),
    (1, "cc0", "creativecommons org", r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    (1, "cc-pdm", "creativecommons org", r"(?:https? )?creativecommons org publicdomain mark 1 0"),
    (1, "cc0", "waived all copyright", r"has waived all copyright and related or neighbou?ring rights"),
    (1, "busl", "change date", r"(?:on|effective on) the change date"),
    (1, "busl", "additional use grant", r"additional use grant"),
    (1, "commons-clause", "right to sell", r"does not grant to you the right to sell the software"),
    (1, "elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    (1, "openrail", "use based restrictions", r"use based restrictions (?:as )?(?:set forth|referenced|listed) in"),
    (2, "non-commercial", "non commercial", r"(?:for|restricted to) non commercial (?:use|purposes|research)(?: only)?"),
    (2, "non-commercial", "noncommercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?"),
    (2, "academic", "research purposes", r"(?:for )?(?:academic|scientific|educational)(?: and| or)?(?: \w+)? research purposes only"),
    (2, "evaluation", "evaluation", r"for (?:internal )?evaluation (?:purposes|use) only"),
    (2, "dual", "dual licen", r"dual licen[cs]ed under"),
    (2, "dual", "either license", r"at your option either license"),
    (2, "proprietary", "trade secret", r"(?:contains|constitutes) (?:confidential (?:information )?and )?trade secrets? (?:of|information)"),
    (2, "proprietary", "confidential", r"confidential (?:and )?(?:unpublished )?property of"),
    (2, "proprietary", "not be reproduced", r"(?:may|must) not be (?:reproduced|copied|redistributed|disclosed)(?: or \w+)? (?:in whole or in part )?without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)"),
    (2, "proprietary", "internal use", r"for internal use only"),
    (2, "government", "restricted rights", r"(?:u s )?government users? restricted rights"),
    (2, "export", "export control", r"subject to (?:u s )?export control"),
    (2, "patent", "patents pending", r"(?:patent|patents) pending"),
    (2, "patent", "patent license", r"(?:worldwide )?(?:royalty free )?(?:irrevocable )?patent licen[cs]e"),
    (3, "freeware", "freeware", r"freeware"),
    (3, "shareware", "shareware", r"shareware"),
    (3, "royalty-free", "royalty free", r"royalty free"),
    (3, "copyleft", "copyleft", r"copyleft"),
    (3, "open-source", "open source", r"open source (?:software|licen[cs]e|initiative)"),
    (3, "terms-of-use", "terms of", r"(?:terms of (?:use|service)|terms and conditions)(?: apply)?"),
    (3, "fair-use", "fair use", r"fair use(?: notice)?"),
    (3, "editorial", "editorial use", r"editorial use only"),
    (3, "personal", "personal use", r"(?:for )?personal use only"),
    (3, "attribution", "attribution", r"attribution (?:is )?required"),
    (2, "public-domain", "public domain", r"(?:dedicated|released|placed|in) (?:to|into|in)? ?the public domain"),
    (3, "public-domain", "public domain", r"public domain"),
    (2, "proprietary", "proprietary", r"proprietary and confidential"),
    (2, "proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction) (?:of this \w+ )?(?:is )?(?:strictly )?prohibited"),
    (2, "all-rights-reserved", "rights reserved", r"(?:copyright (?:c )?(?:\w+ ){0,8})?all rights reserved"),
    (3, "some-rights-reserved", "rights reserved", r"some rights reserved"),
    (3, "no-rights-reserved", "rights reserved", r"no rights reserved"),
    (3, "permission", "permission", r"(?:used|reprinted|reproduced) (?:with|by) permission"),
    (3, "trademark", "trademark", r"(?:registered )?trademarks? of"),
    (4, "copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    (4, "licensed", "licensed", r"licensed under"),
    (4, "license", "license", r"(?:end user )?license (?:agreement|terms|notice|key)"),
]
#: Certainty of a detection by its rule's level.
CERTAINTY = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
_MARK = "\x01"
#: Word parts that many patterns need: texts without them are not searched for those patterns' keywords.
GATES = ("licen", "software", "permi", "copyright", "distribut", "creativecommons", "public", "purposes", "prohibited", "notice", "code", "use")


def _gate(pattern: str) -> str:
    """A common word part that every match of a pattern holds, or nothing: what stays without optional groups, if no other group or choice is left."""
    must, before = pattern, ""
    while must != before:
        must, before = re.sub(r"\(\?:[^()]*\)(?:\?|\{0,\d+\})", "", must), must
    return "" if "|" in must or "(" in must else next((g for g in GATES if g in must), "")


def _gated_rules() -> list[tuple[str, int, str, str, str, str]]:
    framed = [(f"{label}/{part}", level, label, key, frame.format(name), _gate(name)) for level, part, frame in FRAMES for label, key, name in FAMILIES]
    noted = [(f"{label}/notice-{k}", level, label, key, p, _gate(p)) for k, (level, label, key, p) in enumerate(NOTICES)]
    return sorted(framed + noted, key=lambda r: r[1])


def rules() -> list[tuple[str, int, str, str, str]]:
    """(name, level, label, keyword, pattern) in order: earlier rules win over equal later ones."""
    return [r[:5] for r in _gated_rules()]


def _marked(norm: str) -> Column:
    """Of the rules whose keyword a text holds, those that match, each with the text in which its matches are marked.

    Patterns are literals, so each is compiled once in a task; the rules of one keyword stand behind one test for it, and
    keywords behind a test for a word part that all of their matches hold.  The expression is written as SQL, because it has
    thousands of parts; norm names the text's column.
    """
    by: dict[str, dict[str, list[str]]] = {}
    for k, (_, level, label, key, pattern, gate) in enumerate(_gated_rules()):
        by.setdefault(gate, {}).setdefault(key, []).append(f"named_struct('rule', {k}, 'level', {level}, 'label', '{label}', 'marked', regexp_replace(n, r'(?<= )(?:{pattern})(?= )', '{_MARK}$0{_MARK}'))")
    found = lambda made: f"filter(array({', '.join(made)}), r -> contains(r.marked, '{_MARK}'))"
    several = lambda keys: f"flatten(array_compact(array({', '.join(f"case when contains(n, '{key}') then {found(made)} end" for key, made in keys.items())})))"
    kept = [f"case when contains(n, '{gate}') then {several(keys)} end" if gate else several(keys) for gate, keys in by.items()]
    return F.expr(f"transform(array({norm}), n -> flatten(array_compact(array({', '.join(kept)}))))[0]")


def _spans(r: Column) -> Column:
    """Where a rule matches, as (s, e, level, rule, label): the pieces between marks are counted."""

    def hits(to: Column) -> Column:
        at = lambda k: F.element_at(to, k).cast("int")
        return F.transform(F.sequence(F.lit(2), F.size(to) - 1, F.lit(2)), lambda k: F.struct(at(k - 1).alias("s"), at(k).alias("e"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label")))

    sizes = F.transform(F.split(r["marked"], _MARK), lambda x: F.length(x).cast("long"))
    return let(let(sizes, lambda x: running(x, F.lit(0).cast("long"), lambda a, b: a + b)), hits)


def _outermost(found: Column) -> Column:
    """Detections that do not lie within one of the same or a lower level; of equal ones the earliest rule stays."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("back"), d["level"].alias("level"), d["rule"].alias("rule"), d["label"].alias("label"))))

    def reach(d: Column, level: int) -> Column:
        """The furthest end of this or a lower level up to each detection."""
        ends = F.transform(d, lambda x: F.when(x["level"] <= level, -x["back"]).otherwise(-1).cast("long"))
        return running(ends, F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))

    def kept(d: Column, far: Column) -> Column:
        inside = lambda x, i: (i > 0) & (F.element_at(F.element_at(far, x["level"]), F.greatest(i, F.lit(1))) >= -x["back"])
        return F.transform(F.filter(d, lambda x, i: ~inside(x, i)), lambda x: F.struct(x["s"].alias("s"), (-x["back"]).alias("e"), x["level"].alias("level"), x["rule"].alias("rule"), x["label"].alias("label")))

    return let(ordered, lambda d: let(F.array(*[reach(d, level) for level in CERTAINTY]), lambda far: kept(d, far)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections of every row of docs.

    A text's lower-cased words, joined by spaces, are what the rules see.  A text costs one look for each keyword; each rule
    whose keyword occurs is matched everywhere, and a detection inside one of a rule of the same or a higher rank is
    suppressed.  detections: (s, e) in that joined text, level, rule (a number in rules()) and label.  score: the certainty
    of the best detection; a base phrase counts 0.5 at least.  Base labels stay whatever is suppressed.  Everything happens
    within the row: no shuffle, and no group can be hot.

    Null and empty texts have no words, no labels and score 0.  Null ids and repeated rows are rows as any other; an empty
    table gives no rows; other columns are not read.
    """

    def place(phrase: str) -> Column:
        parts = phrase.split(" ")
        at = lambda i: reduce(and_, [F.element_at("w", i + k + 1) == p for k, p in enumerate(parts)])
        none = F.array().cast("array<int>")
        return F.when(F.contains("norm", F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size("w") - len(parts)), at)).otherwise(none)

    row = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("w"))
    row = row.select("doc_id", "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("norm"))
    row = row.select("doc_id", F.size("w").alias("n"), *[place(p).alias(f"at_{label}") for p, label in BASE.items()], _marked("norm").alias("marked"))
    none = F.array().cast("array<struct<s:int,e:int,level:int,rule:int,label:string>>")
    found = F.when(F.size("marked") > 0, _outermost(F.flatten(F.transform("marked", _spans)))).otherwise(none)
    row = row.select("doc_id", F.struct("n", *[F.col(f"at_{label}").alias(label) for label in BASE.values()], found.alias("found")).alias("x"))
    places = F.concat(*[F.col("x")[label] for label in BASE.values()])
    base = F.array_compact(F.array(*[F.when(F.size(F.col("x")[label]) > 0, F.lit(label)) for label in sorted(BASE.values())]))
    row = row.select("doc_id", F.col("x.n").cast("long").alias("n_words"), places.alias("places"), base.alias("base"), F.col("x.found").alias("detections"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    certainty = F.create_map(*[F.lit(v) for pair in CERTAINTY.items() for v in pair])
    best = F.array_max(F.transform("detections", lambda d: F.element_at(certainty, d["level"])))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    n = F.size("places")
    return row.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "detections",
    )
