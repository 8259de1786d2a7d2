"""License scans: ordered signature rules behind a keyword prefilter; overlapping detections are resolved by priority and containment."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, UPPER, read

_FOLD = str.maketrans(UPPER, LOWER)
#: Words of the contract, and the same on texts that are not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

#: Licences: label, identifiers, name (a regular expression over lower-case text), address (or empty).
LICENCES = (
    ("mit", "mit", r"(?:the )?(?:mit|expat)(?:/expat)? licen[cs]e", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit-0", r"mit no attribution(?: license)?", r""),
    ("apache-2.0", "apache-2.0", r"(?:the )?apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache-1.1", r"(?:the )?apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("gpl-1.0", "gpl-1.0|gpl-1.0-only|gpl-1.0-or-later", r"(?:gnu )?(?:gpl|general public licen[cs]e),? (?:version |v\.? ?)?1(?:\.0)?(?!\.?\d)", r""),
    ("gpl-2.0", "gpl-2.0|gpl-2.0-only|gpl-2.0-or-later", r"(?:gnu )?(?:gpl|general public licen[cs]e),? (?:version |v\.? ?)?2(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl-3.0|gpl-3.0-only|gpl-3.0-or-later", r"(?:gnu )?(?:gpl|general public licen[cs]e),? (?:version |v\.? ?)?3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", "lgpl-2.1|lgpl-2.1-only|lgpl-2.1-or-later", r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e),? (?:version |v\.? ?)?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl-3.0|lgpl-3.0-only|lgpl-3.0-or-later", r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e),? (?:version |v\.? ?)?3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "agpl-3.0|agpl-3.0-only|agpl-3.0-or-later", r"(?:gnu )?(?:agpl|affero general public licen[cs]e),? (?:version |v\.? ?)?3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", "gfdl-1.3", r"gnu free documentation licen[cs]e(?:,? (?:version )?1\.3)?", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:the )?(?:simplified bsd|bsd[ -]2[ -]clause|2[ -]clause bsd|freebsd)(?: licen[cs]e)?", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:the )?(?:new bsd|modified bsd|bsd[ -]3[ -]clause|3[ -]clause bsd)(?: licen[cs]e)?", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:the )?(?:original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd)(?: licen[cs]e)?", r""),
    ("bsd", "bsd", r"(?:the )?bsd[ -](?:style )?licen[cs]e", r""),
    ("0bsd", "0bsd", r"(?:zero[ -]clause bsd|bsd zero[ -]clause)(?: licen[cs]e)?", r""),
    ("mpl-1.1", "mpl-1.1", r"mozilla public licen[cs]e,? (?:version |v\.? ?)?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl-2.0", r"mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "epl-1.0", r"eclipse public licen[cs]e(?: -)?,? (?:version |v\.? ?)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl-2.0", r"eclipse public licen[cs]e(?: -)?,? (?:version |v\.? ?)?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", "cddl-1.0", r"common development and distribution licen[cs]e(?:,? (?:version )?1\.0)?", r""),
    ("cpl-1.0", "cpl-1.0", r"common public licen[cs]e(?:,? (?:version )?1\.0)?", r""),
    ("eupl-1.2", "eupl-1.2", r"european union public licen[cs]e(?:,? (?:version |v\.? ?)?1\.2)?", r""),
    ("isc", "isc", r"(?:the )?isc licen[cs]e", r"opensource\.org/licenses?/isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)? licen[cs]e", r""),
    ("bsl-1.0", "bsl-1.0", r"boost software licen[cs]e(?:,? (?:version )?1\.0)?", r"boost\.org/license_1_0"),
    ("artistic-2.0", "artistic-2.0", r"(?:the )?artistic licen[cs]e,? (?:version )?2(?:\.0)?", r""),
    ("artistic-1.0", "artistic-1.0", r"(?:the )?artistic licen[cs]e,? (?:version )?1(?:\.0)?", r""),
    ("python-2.0", "python-2.0|psf-2.0", r"python software foundation licen[cs]e", r""),
    ("php-3.01", "php-3.01", r"(?:the )?php licen[cs]e,? (?:version )?3\.01", r""),
    ("ofl-1.1", "ofl-1.1", r"sil open font licen[cs]e(?:,? (?:version )?1\.1)?", r"scripts\.sil\.org/ofl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense(?=[ ,.;)]|$)", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", r""),
    ("cc0-1.0", "cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by-2.0", "cc-by-2.0", r"cc[ -]by[ -]2\.0|creative commons attribution 2\.0", r"creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-3.0", "cc-by-3.0", r"cc[ -]by[ -]3\.0|creative commons attribution 3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", "cc-by-4.0", r"cc[ -]by[ -]4\.0|creative commons attribution 4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa-3.0", "cc-by-sa-3.0", r"cc[ -]by-sa[ -]3\.0|creative commons attribution[ -]sharealike 3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-sa-4.0", "cc-by-sa-4.0", r"cc[ -]by-sa[ -]4\.0|creative commons attribution[ -]sharealike 4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-nc-3.0", "cc-by-nc-3.0", r"cc[ -]by-nc[ -]3\.0|creative commons attribution[ -]noncommercial 3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nc-4.0", "cc-by-nc-4.0", r"cc[ -]by-nc[ -]4\.0|creative commons attribution[ -]noncommercial 4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nd-4.0", "cc-by-nd-4.0", r"cc[ -]by-nd[ -]4\.0|creative commons attribution[ -]noderivatives 4\.0", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa-4.0", "cc-by-nc-sa-4.0", r"cc[ -]by-nc-sa[ -]4\.0|creative commons attribution[ -]noncommercial[ -]sharealike 4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-4.0", "cc-by-nc-nd-4.0", r"cc[ -]by-nc-nd[ -]4\.0|creative commons attribution[ -]noncommercial[ -]noderivatives 4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("odbl-1.0", "odbl-1.0", r"open (?:data commons open )?database licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("ms-pl", "ms-pl", r"microsoft public licen[cs]e", r""),
    ("ms-rl", "ms-rl", r"microsoft reciprocal licen[cs]e", r""),
    ("afl-3.0", "afl-3.0", r"academic free licen[cs]e(?:,? (?:version |v\.? ?)?3\.0)?", r""),
    ("osl-3.0", "osl-3.0", r"open software licen[cs]e(?:,? (?:version |v\.? ?)?3\.0)?", r""),
    ("upl-1.0", "upl-1.0", r"universal permissive licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?", r""),
    ("ncsa", "ncsa", r"university of illinois/ncsa open source licen[cs]e", r""),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[cs]e", r""),
    ("openssl", "openssl", r"(?:the )?openssl licen[cs]e", r""),
    ("elastic-2.0", "elastic-2.0", r"elastic licen[cs]e,? (?:version )?2(?:\.0)?", r""),
    ("sspl-1.0", "sspl-1.0", r"server side public licen[cs]e", r""),
    ("busl-1.1", "busl-1.1", r"business source licen[cs]e(?:,? (?:version )?1\.1)?", r""),
    ("bigscience-rail", "bigscience-openrail-m", r"(?:bigscience )?open ?rail(?:[ -]m)?(?: licen[cs]e)?", r""),
)
#: Families whose short form with a version (GPLv2, LGPL 2.1, Apache-2.0, MPL 2.0+) stands for the licence.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mpl", "epl", "eupl", "cddl", "gfdl")
_Q = "[\"'‘’“”]?"
#: Signature sentences, written by hand: label, sentence, priority, weight, stem, keyword. Every match holds the stem and the keyword;
#: stems are few, as the gate looks for them in every text, keywords are rare words of the sentence.
SENTENCES = (
    # permissive
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", 90, 0.95, "permi", "obtaining"),
    ("mit", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software", 85, 0.9, "permi", "substantial"),
    ("mit", rf"the software is provided {_Q}as is{_Q},? without warranty of any kind, express or implied", 70, 0.7, "warrant", "implied"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", 70, 0.7, "copyright", "liability"),
    ("mit-0", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{0,200}\bto permit persons to whom the software is furnished to do so\.(?! subject)", 60, 0.4, "permi", "furnished"),
    ("x11", r"except as contained in this notice, the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale", 85, 0.9, "advertis", "advertising"),
    ("isc", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", 90, 0.95, "permi", "hereby"),
    ("isc", rf"the software is provided {_Q}as is{_Q} and .{{1,60}}? disclaims all warranties with regard to this software", 85, 0.9, "warrant", "disclaims"),
    ("curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", 92, 0.9, "permi", "hereby"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", 88, 0.85, "permi", "documentation"),
    ("hpnd", r"historical permission notice and disclaimer", 80, 0.8, "permi", "historical"),
    ("libtiff", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee", 90, 0.9, "permi", "sell"),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", 92, 0.95, "permi", "agreement"),
    ("tcl", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose", 90, 0.95, "permi", "documentation"),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 92, 0.95, "permi", "organization"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted", 80, 0.9, "permi", "redistribution"),
    ("bsd", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", 75, 0.85, "copyright", "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions", 75, 0.85, "copyright", "redistributions"),
    ("bsd", rf"this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? {_Q}as is{_Q}", 70, 0.75, "software", "provided"),
    ("bsd-3-clause", r"neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products", 85, 0.9, "endorse", "endorse"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party's patent rights are granted by this license", 90, 0.95, "licen", "patent"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 88, 0.95, "software", "advertising"),
    ("bsd-source-code", r"redistribution of (?:this )?source code must retain the above copyright notice", 60, 0.6, "copyright", "redistribution"),
    ("zlib", rf"this software is provided {_Q}as-is{_Q}, without any express or implied warranty", 85, 0.9, "warrant", "as-is"),
    ("zlib", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", 88, 0.95, "software", "misrepresented"),
    ("zlib", r"the origin of this software must not be misrepresented", 85, 0.9, "software", "misrepresented"),
    ("libpng", r"the contributing authors and group 42, inc\. disclaim all warranties", 90, 0.95, "warrant", "disclaim"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", 90, 0.95, "software", "jpeg"),
    ("ftl", r"portions of this software are copyright .{1,60}? the freetype project", 90, 0.95, "copyright", "freetype"),
    ("json", r"the software shall be used for good, not evil", 90, 0.95, "software", "evil"),
    ("beerware", r"if we meet some ?day, and you think this stuff is worth it, you can buy me a beer", 90, 0.95, "beer", "beer"),
    ("beerware", rf"{_Q}the beer-?ware licen[cs]e{_Q}", 85, 0.9, "licen", "beer"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", 92, 0.95, "licen", "verbatim"),
    ("fsfap", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty", 90, 0.95, "permi", "royalty"),
    ("fsful", r"this configure script is free software; the free software foundation gives unlimited permission to copy, distribute and modify it", 90, 0.95, "permi", "unlimited"),
    ("fsfullr", r"this file is free software; the free software foundation gives unlimited permission to copy and/or distribute it", 90, 0.95, "permi", "unlimited"),
    ("unicode-dfs", r"unicode,? inc\. licen[cs]e agreement", 85, 0.9, "licen", "unicode"),
    ("unicode-dfs", r"copyright (?:©|\(c\)) [0-9-]+ unicode,? inc\.", 60, 0.6, "copyright", "unicode"),
    ("icu", r"\bicu licen[cs]e", 70, 0.8, "licen", "icu"),
    ("bitstream-vera", r"bitstream vera (?:fonts? )?copyright", 85, 0.9, "copyright", "bitstream"),
    ("sgi-b-2.0", r"sgi free software licen[cs]e b", 85, 0.9, "licen", "sgi"),
    ("info-zip", r"info-zip licen[cs]e", 80, 0.85, "licen", "info-zip"),
    ("imagemagick", r"imagemagick licen[cs]e", 80, 0.85, "licen", "imagemagick"),
    ("upl-1.0", r"subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data", 92, 0.95, "permi", "condition"),
    ("ncsa", r"permission is hereby granted, free of charge, .{1,80}? to deal with the software without restriction", 70, 0.6, "permi", "restriction"),
    ("blueoak-1.0.0", r"blue oak model licen[cs]e", 85, 0.9, "licen", "oak"),
    ("mulanpsl-2.0", r"mulan (?:psl|permissive software licen[cs]e)(?:,? v(?:ersion )?2)?", 85, 0.9, "mulan", "mulan"),
    ("zpl-2.1", r"zope public licen[cs]e(?: \(zpl\))?", 80, 0.85, "licen", "zope"),
    ("w3c", r"w3c(?:®)? (?:software|document) (?:notice and )?licen[cs]e", 80, 0.85, "licen", "w3c"),
    ("vsl-1.0", r"vovida software licen[cs]e", 80, 0.85, "licen", "vovida"),
    ("xerox", r"xerox licen[cs]e", 60, 0.6, "licen", "xerox"),
    ("efl-2.0", r"eiffel forum licen[cs]e", 80, 0.85, "licen", "eiffel"),
    ("ecl-2.0", r"educational community licen[cs]e", 80, 0.85, "licen", "educational"),
    ("ntp", r"\bntp licen[cs]e", 70, 0.8, "licen", "ntp"),
    ("blessing", r"may you do good and not evil", 85, 0.9, "evil", "evil"),
    ("blessing", r"the authors? disclaims? copyright to this source code", 85, 0.9, "copyright", "disclaim"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", 88, 0.9, "software", "verbatim"),
    ("vim", r"vim is charityware", 90, 0.95, "charityware", "charityware"),
    # apache
    ("apache-2.0", rf"licensed under the apache license, version 2\.0 \(the {_Q}license{_Q}\);? you may not use this file except in compliance with the license", 97, 0.98, "licen", "compliance"),
    ("apache-2.0", rf"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an {_Q}as is{_Q} basis", 85, 0.9, "licen", "applicable"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", 90, 0.95, "licen", "irrevocable"),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", 90, 0.95, "licen", "asf"),
    ("apache-1.1", r"this product includes software developed by the apache (?:software foundation|group)", 80, 0.85, "software", "apache"),
    ("llvm-exception", r"llvm exceptions? to the apache 2\.0 licen[cs]e|apache licen[cs]e v?2\.0 with llvm exceptions?", 98, 0.95, "licen", "llvm"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 85, 0.9, "software", "openssl"),
    ("ssleay", r"this product includes cryptographic software written by eric young", 88, 0.95, "software", "cryptographic"),
    # copyleft
    ("gpl", r"this program is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e", 70, 0.9, "licen", "redistribute"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", 70, 0.85, "licen", "received"),
    ("gpl", r"as published by the free software foundation", 40, 0.5, "software", "foundation"),
    ("gpl", r"this program is distributed in the hope that it will be useful, but without any warranty", 60, 0.7, "warrant", "hope"),
    ("gpl-1.0", r"either version 1,? of the license,? or \(at your option\) any later version", 86, 0.85, "licen", "option"),
    ("gpl-2.0", r"either version 2 of the license, or \(at your option\) any later version", 86, 0.85, "licen", "option"),
    ("gpl-3.0", r"either version 3 of the license, or \(at your option\) any later version", 86, 0.85, "licen", "option"),
    ("lgpl-2.1", r"either version 2\.1 of the license, or \(at your option\) any later version", 86, 0.85, "licen", "option"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it", 88, 0.9, "licen", "freedom"),
    ("gpl-3.0", r"the gnu general public license is a free, copyleft license for software and other kinds of works", 92, 0.95, "licen", "copyleft"),
    ("gpl-3.0", r"the licenses for most software and other practical works are designed to take away your freedom", 88, 0.9, "licen", "practical"),
    ("gpl", r"each time you redistribute the program \(or any work based on the program\), the recipient automatically receives a license", 85, 0.85, "licen", "recipient"),
    ("lgpl", r"this library is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 75, 0.9, "licen", "library"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 75, 0.85, "licen", "received"),
    ("lgpl-2.1", r"this license, the lesser general public license, applies to some specially designated software packages", 90, 0.95, "licen", "designated"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 92, 0.95, "licen", "incorporates"),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license along with", 80, 0.9, "licen", "affero"),
    ("agpl-3.0", r"remote network interaction;? use with the gnu general public license", 90, 0.95, "licen", "remote"),
    ("agpl-3.0", r"specifically designed to ensure cooperation with the community in the case of network server software", 90, 0.95, "software", "cooperation"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e", 85, 0.95, "licen", "documentation"),
    ("gfdl", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts", 80, 0.9, "invariant", "invariant"),
    ("gpl-linking-exception", r"as a special exception, the copyright holders of this library give you permission to link this library with independent modules", 90, 0.95, "permi", "exception"),
    ("gpl-openssl-exception", r"permission to link the code of portions of this program with the openssl library", 90, 0.95, "permi", "openssl"),
    ("classpath-exception-2.0", r"classpath exception|oracle designates this particular file as subject to the .{0,3}classpath.{0,3} exception", 85, 0.9, "classpath", "classpath"),
    ("gcc-exception-3.1", r"gcc runtime library exception", 85, 0.9, "gcc", "gcc"),
    ("autoconf-exception", r"part of a program that contains a configuration script generated by autoconf", 88, 0.9, "autoconf", "autoconf"),
    ("bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton", 88, 0.9, "bison", "bison"),
    ("font-exception-2.0", r"if you create a document which uses this font, and embed this font or unaltered portions of this font into the document", 88, 0.9, "unaltered", "unaltered"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", 92, 0.98, "licen", "mozilla"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one at", 90, 0.95, "mpl", "mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", 92, 0.98, "licen", "mozilla"),
    ("mpl-2.0-no-copyleft-exception", rf"this source code form is {_Q}incompatible with secondary licenses{_Q}", 93, 0.95, "licen", "incompatible"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 80, 0.9, "licen", "eclipse"),
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses when the conditions for such availability", 90, 0.95, "licen", "availability"),
    ("epl-1.0", rf"the accompanying program is provided under the terms of this eclipse public license \({_Q}agreement{_Q}\)", 85, 0.9, "licen", "eclipse"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", 90, 0.95, "licen", "accompanying"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", 92, 0.95, "licen", "development"),
    ("eupl-1.2", r"licensed under the eupl", 85, 0.9, "licen", "eupl"),
    ("cecill-2.1", r"this software is governed by the cecill(?:-[bc])? license under french law", 92, 0.95, "licen", "cecill"),
    ("cecill-2.1", r"cecill(?:-[bc])? (?:free software )?licen[cs]e", 80, 0.85, "licen", "cecill"),
    ("lppl-1.3c", r"this work may be distributed and/or modified under the conditions of the latex project public license", 92, 0.95, "licen", "latex"),
    ("qpl-1.0", r"\bq public licen[cs]e", 80, 0.85, "licen", "licen"),
    ("ipl-1.0", r"ibm public licen[cs]e", 80, 0.9, "licen", "ibm"),
    ("apsl-2.0", r"apple public source licen[cs]e", 85, 0.9, "licen", "apple"),
    ("sissl", r"sun industry standards source licen[cs]e", 85, 0.9, "licen", "industry"),
    ("nasa-1.3", r"nasa open source agreement", 85, 0.9, "nasa", "nasa"),
    ("rpl-1.5", r"reciprocal public licen[cs]e", 80, 0.85, "licen", "reciprocal"),
    ("cpal-1.0", r"common public attribution licen[cs]e", 80, 0.85, "licen", "attribution"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for", 90, 0.95, "redistributions", "redistributions"),
    ("oldap-2.8", r"(?:the )?openldap public licen[cs]e", 85, 0.9, "licen", "openldap"),
    ("watcom-1.0", r"sybase open watcom public licen[cs]e", 85, 0.9, "licen", "watcom"),
    ("rpsl-1.0", r"realnetworks public source licen[cs]e", 85, 0.9, "licen", "realnetworks"),
    ("rscpl", r"ricoh source code public licen[cs]e", 85, 0.9, "licen", "ricoh"),
    ("nokia", r"nokia open source licen[cs]e", 85, 0.9, "licen", "nokia"),
    ("lpl-1.02", r"lucent public licen[cs]e", 85, 0.9, "licen", "lucent"),
    ("spl-1.0", r"sun public licen[cs]e", 80, 0.85, "licen", "sun"),
    ("wxwindows", r"wxwindows library licen[cs]e", 85, 0.9, "licen", "wxwindows"),
    ("ogtsl", r"open group test suite licen[cs]e", 85, 0.9, "licen", "suite"),
    ("npl-1.1", r"netscape public licen[cs]e", 80, 0.85, "licen", "netscape"),
    ("parity", r"parity public licen[cs]e", 80, 0.85, "licen", "parity"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", 90, 0.9, "copied", "intent"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied, modified, distributed", 92, 0.95, "licen", "establishes"),
    ("artistic-or-gpl", r"under the same terms as perl itself", 80, 0.85, "perl", "perl"),
    ("python-2.0", r"this license agreement is between the python software foundation", 92, 0.95, "licen", "python"),
    ("python-2.0", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide license", 92, 0.95, "licen", "psf"),
    ("php-3.01", r"this product includes php(?: software)?, freely available from", 85, 0.9, "php", "php"),
    # fonts, documents, art
    ("ofl-1.1", r"this font software is licensed under the sil open font licen[cs]e", 92, 0.98, "licen", "font"),
    ("ofl-1.1", r"no modified version of the font software may use the reserved font names?", 88, 0.9, "reserved", "font"),
    ("ubuntu-font-1.0", r"ubuntu font licen[cs]e", 85, 0.9, "licen", "ubuntu"),
    ("arphic-1999", r"arphic public licen[cs]e", 85, 0.9, "licen", "arphic"),
    ("gfl", r"gust font licen[cs]e", 85, 0.9, "licen", "gust"),
    ("lal-1.3", r"licence art libre|free art licen[cs]e .{0,40}libre", 80, 0.85, "licen", "libre"),
    ("opl-1.0", r"open publication licen[cs]e", 80, 0.85, "licen", "publication"),
    ("opencontent-1.0", r"open ?content licen[cs]e", 75, 0.8, "licen", "content"),
    ("dsl", r"design science licen[cs]e", 80, 0.85, "licen", "design"),
    ("cdl-1.0", r"common documentation licen[cs]e", 80, 0.85, "licen", "documentation"),
    # public domain
    ("unlicense", r"this is free and unencumbered software released into the public domain", 90, 0.95, "domain", "unencumbered"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", 88, 0.9, "software", "compile"),
    ("public-domain", r"(?:released into|dedicated to|in) the public domain", 40, 0.6, "domain", "domain"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", 92, 0.95, "domain", "deed"),
    ("cc0-1.0", r"to the extent possible under law, .{1,120}? waived all copyright and related or neighboring rights", 92, 0.95, "copyright", "waived"),
    ("pdm-1.0", r"free of known (?:copyright restrictions|restrictions under copyright law)", 85, 0.9, "copyright", "restrictions"),
    ("pddl-1.0", r"open data commons public domain dedication(?: and| &) licen[cs]e", 85, 0.95, "licen", "dedication"),
    # creative commons and data
    ("cc", r"creative commons licen[cs]e", 30, 0.6, "licen", "creative"),
    ("cc-by-4.0", r"creative commons attribution 4\.0 international(?: public)? licen[cs]e", 92, 0.98, "licen", "attribution"),
    ("cc-by-sa-4.0", r"creative commons attribution-sharealike 4\.0 international(?: public)? licen[cs]e", 92, 0.98, "licen", "attribution"),
    ("cc-by-nc-4.0", r"creative commons attribution-noncommercial 4\.0 international(?: public)? licen[cs]e", 92, 0.98, "licen", "attribution"),
    ("cc-by-nd-4.0", r"creative commons attribution-noderivatives 4\.0 international(?: public)? licen[cs]e", 92, 0.98, "licen", "attribution"),
    ("cc-by-3.0", r"creative commons attribution 3\.0 unported licen[cs]e", 92, 0.98, "licen", "unported"),
    ("cc-by-sa-3.0", r"creative commons attribution-share ?alike 3\.0 unported licen[cs]e", 92, 0.98, "licen", "unported"),
    ("cc-by-sa", r"text is available under the creative commons attribution-share ?alike licen[cs]e", 80, 0.9, "licen", "attribution"),
    ("cc-by", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made", 80, 0.9, "licen", "credit"),
    ("cc-by-sa", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license", 85, 0.9, "licen", "remix"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", 80, 0.85, "commercial", "material"),
    ("cc-by-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material", 85, 0.9, "remix", "remix"),
    ("cc", r"some rights reserved", 25, 0.4, "reserved", "reserved"),
    ("odbl-1.0", r"any rights in individual contents of the database are licensed under the database contents licen[cs]e", 90, 0.95, "licen", "database"),
    ("odbl-1.0", r"this .{1,60}? is made available under the open database licen[cs]e", 88, 0.95, "licen", "database"),
    ("odc-by-1.0", r"open data commons attribution licen[cs]e", 85, 0.95, "licen", "commons"),
    ("ogl-uk-3.0", r"contains public sector information licensed under the open government licence v3\.0", 90, 0.95, "licen", "government"),
    ("ogl-uk", r"open government licence", 75, 0.85, "licen", "government"),
    ("ogl-canada", r"open government licence (?:-|–) canada", 85, 0.9, "licen", "canada"),
    ("etalab-2.0", r"licence ouverte|open licence 2\.0", 80, 0.85, "licence", "licence"),
    ("dl-de", r"datenlizenz deutschland", 80, 0.9, "datenlizenz", "datenlizenz"),
    ("cdla", r"community data licen[cs]e agreement", 85, 0.9, "licen", "community"),
    # models and source-available
    ("openrail", r"use-based restrictions", 60, 0.6, "use-based", "use-based"),
    ("llama-community", r"llama(?: 2| 3(?:\.\d)?| 4)? community licen[cs]e", 88, 0.95, "licen", "llama"),
    ("gemma", r"gemma terms of use", 85, 0.9, "gemma", "gemma"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work", 92, 0.95, "licen", "non-production"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", 92, 0.95, "software", "hosted"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", 92, 0.95, "functionality", "functionality"),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?", 80, 0.85, "commons", "clause"),
    ("confluent-community", r"confluent community licen[cs]e", 85, 0.9, "licen", "confluent"),
    ("polyform", r"polyform (?:noncommercial|small business|perimeter|shield|strict|free trial|internal use) licen[cs]e", 85, 0.95, "licen", "polyform"),
    ("timescale", r"timescale licen[cs]e", 80, 0.85, "licen", "timescale"),
    ("ms-pl", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software", 90, 0.9, "licen", "accept"),
    ("ms-rsl", r"microsoft reference source licen[cs]e", 88, 0.95, "licen", "microsoft"),
    # proprietary
    ("proprietary", r"microsoft software licen[cs]e terms", 80, 0.9, "licen", "microsoft"),
    ("proprietary", r"oracle (?:binary code|technology network) licen[cs]e agreement", 85, 0.95, "licen", "oracle"),
    ("proprietary", r"end[ -]user licen[cs]e agreement", 70, 0.8, "licen", "user"),
    ("proprietary", r"all rights reserved", 20, 0.3, "reserved", "reserved"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", 60, 0.8, "proprietary", "proprietary"),
    ("proprietary", r"no part of this (?:publication|book|document|work|site) may be reproduced", 65, 0.8, "reproduced", "reproduced"),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|use|distribution|duplication)[a-z ,/]{0,80}? (?:is|are) (?:strictly )?prohibited", 65, 0.8, "prohibited", "prohibited"),
    ("proprietary", r"for internal use only", 35, 0.4, "internal", "internal"),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed|republished)[a-z ,/]{0,60}? without (?:the )?(?:prior |express )?(?:written )?permission", 60, 0.7, "permi", "permission"),
    ("noncommercial", r"for (?:personal,? |private,? )?non-?commercial use only", 45, 0.6, "commercial", "commercial"),
    ("noncommercial", r"commercial use (?:of .{1,60}? )?is (?:strictly )?(?:prohibited|forbidden)", 45, 0.6, "commercial", "commercial"),
    ("research-only", r"for academic(?: (?:and|or) (?:educational|research))? (?:use|purposes) only", 45, 0.6, "academic", "academic"),
    ("research-only", r"for research(?: (?:and|or) (?:academic|educational))? (?:use|purposes) only", 45, 0.6, "research", "research"),
    ("shareware", r"this (?:program|software) is shareware", 60, 0.8, "shareware", "shareware"),
    ("freeware", r"this (?:program|software) is freeware", 60, 0.7, "freeware", "freeware"),
    # families
    ("gpl", r"(?:gnu )?general public licen[cs]e", 30, 0.6, "licen", "general"),
    ("lgpl", r"(?:gnu )?lesser general public licen[cs]e", 35, 0.6, "licen", "lesser"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", 35, 0.6, "licen", "affero"),
    ("apache", r"apache licen[cs]e", 30, 0.6, "licen", "apache"),
    ("copyright", r"copyright (?:\(c\)|©) \d{4}", 10, 0.2, "copyright", "copyright"),
    ("copyright", r"copyright \d{4}(?:-\d{4})? by ", 10, 0.2, "copyright", "copyright"),
)
#: Keywords of the names that can do without "licen": every alternative of the name holds one of them. No keyword holds white space
#: that a line break can stand for; the blank of "cc by" is of "[ -]", which is a blank or a hyphen alone.
NAME_KEYWORDS = {
    "mit-0": ("attribution",),
    **dict.fromkeys(("gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"), ("gpl", "licen")),
    **dict.fromkeys(("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsd", "0bsd"), ("bsd",)),
    "wtfpl": ("wtfpl", "licen"),
    "cc0-1.0": ("cc0",),
    **{label: ("cc by", "cc-by", "creative") for label, *_ in LICENCES if label.startswith("cc-by")},
    "bigscience-rail": ("rail",),
}


#: What Python takes for white space, spelt out for Java.
_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_GRANTED = "licen[cs]ed|released|distributed|available|provided|covered|published|is|are|falls?"
_IDS = {i: label for label, ids, *_ in LICENCES for i in ids.split("|")}
#: The places of short forms and of grants by identifier, each with the family or identifier that tells which rules may fit there.
SHORT = rf"({'|'.join(FAMILIES)})(?:[ ,-]{{0,2}}v(?:ersion|\.)?)?[ -]?[0-9]"
GRANT = rf"under{_WS}(?:(?:the|terms|of|gnu){_WS}){{0,5}}({'|'.join(map(re.escape, sorted([*_IDS, *FAMILIES], key=lambda i: (-len(i), i))))})"


def _short(label: str) -> str | None:
    """The short form of a family's version: a sign, v or version between may lack, and so may a minor version of 0."""
    family, _, version = label.rpartition("-")
    if family not in FAMILIES:
        return None
    major, minor = version.split(".")
    return rf"(?:gnu[ ])?{family}(?:[ ,-]{{0,2}}v(?:ersion|\.)?)?[ -]?{major}(?:\.{minor}){'?' if minor == '0' else ''}(?:\+|-only|-or-later)?(?!\.?\d)"


@cache
def _rules() -> tuple[tuple[int, str, float, re.Pattern, tuple[str, ...], tuple[str, ...]], ...]:
    """The rules, each with its keywords and stems: every text that the pattern matches holds at least one of either. Those without keywords match where SHORT or GRANT does."""
    edge_l, edge_r = r"(?<![a-z0-9])", r"(?![a-z0-9])"
    out = []
    for label, ids, name, address in LICENCES:
        own = NAME_KEYWORDS.get(label, ("licen",))
        any_id = "|".join(map(re.escape, sorted(ids.split("|"), key=len, reverse=True)))
        short = _short(label)
        named = f"{any_id}|{short}" if short else any_id
        forms = [
            (100, 1.0, rf"spdx-license-identifier:\s*\(?(?:{any_id})(?![a-z0-9.-])", ("spdx",)),
            (95, 0.95, rf"{edge_l}(?:https?://)?(?:www\.)?{address}" if address else None, (address.split("/")[0].replace("\\", ""),)),
            (85, 0.9, rf"{edge_l}(?:licen[cs]ed|released|distributed|available|provided|published|covered|shared) (?:only )?(?:under|by|with) (?:the )?(?:terms of )?(?:the )?(?:{name}){edge_r}", own),
            (84, 0.9, rf"{edge_l}(?:{_GRANTED}) (?:only )?under (?:the )?(?:terms of )?(?:the )?(?:{named})(?: licen[cs]e)?{edge_r}", ()),
            (75, 0.8, rf"{edge_l}licen[cs]e\s*[:=]\s*[\"']?(?:{named}|{name}){edge_r}", ("licen",)),
            (55, 0.7, rf"{edge_l}(?:{short})(?: licen[cs]e)?{edge_r}" if short else None, ()),
            (50, 0.7, rf"{edge_l}(?:{name}){edge_r}" if "licen" in name or label.startswith("cc") else None, own),
        ]
        out += [(p, label, w, f, k, k) for p, w, f, k in forms if f]
    out += [(p, label, w, edge_l + s, (k,), (stem,)) for label, s, p, w, stem, k in SENTENCES]
    # A blank of a signature stands for any white space: licences are wrapped into lines.
    out = [(p, label, w, re.compile(re.sub(r"(?<!\[) (?!-\])", r"\\s+", f).replace(r"\s+?", r"\s*"), re.DOTALL), k, stem) for p, label, w, f, k, stem in out]
    return tuple(sorted(out, key=lambda r: (-r[0], r[1], r[3].pattern)))


def rules() -> tuple[tuple[int, str, float, re.Pattern], ...]:
    """(priority, label, weight, pattern), ordered: every licence as declared identifier, address, grant and bare name, and the sentences."""
    return tuple(r[:4] for r in _rules())


#: A text that holds none of these and no place of SHORT or GRANT holds no detection: the prefilter before the texts leave the JVM.
STEMS = tuple(sorted({k for r in _rules() for k in r[5]}))
PLACES = f"{SHORT}|{GRANT}"


@cache
def _index():
    """(automaton of the keywords, rules of each keyword, PLACES as a pattern, rules of each identifier and family at a place)."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for i, r in enumerate(_rules()):
        for k in r[4]:
            of.setdefault(k, []).append(i)
    a = ahocorasick.Automaton()
    for k in of:
        a.add_word(k, k)
    a.make_automaton()
    placed: dict[str, list[int]] = {}
    for i, r in enumerate(_rules()):
        if not r[4]:
            for k in [k for k, label in _IDS.items() if label == r[1]] + [r[1].rpartition("-")[0]]:
                placed.setdefault(k, []).append(i)
    return a, of, re.compile(PLACES), placed


def detect(text: str, gated: bool = True) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, weight) that stay of all rules' matches in a lower-cased text, by start.

    One pass finds the keywords of the text, and only their rules are tried; ungated, every rule is, with the same result. A match that
    lies within another of higher priority, or of the same priority and longer (of equal ones the first label), is suppressed: in the
    order of start and falling end, all that can hold a match come before it, so the furthest end of each priority so far decides.
    """
    if gated:
        automaton, of, places, placed = _index()
        tried = {i for k in {k for _, k in automaton.iter(text)} for i in of[k]}
        tried |= {i for k in {m[1] or m[2] for m in places.finditer(text)} for i in placed[k]}
    else:
        tried = range(len(_rules()))
    found = []
    for i in sorted(tried):
        priority, label, weight, pattern = _rules()[i][:4]
        found += [(m.start(), m.end(), priority, label, weight) for m in pattern.finditer(text)]
    stays, furthest = [], {}
    for f in sorted(found, key=lambda f: (f[0], -f[1], -f[2], f[3])):
        if not any(e >= f[1] for p, e in furthest.items() if p >= f[2]):
            stays.append(f)
        furthest[f[2]] = max(furthest.get(f[2], 0), f[1])
    return sorted(stays)


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(word, label) of each place where a base phrase's words stand one after the other, repeats included."""
    out, at = [], -1
    while True:
        try:
            at = words.index("license", at + 1)
        except ValueError:
            return out
        for phrase, label in BASE:
            n = len(phrase)
            if at >= n - 1 and tuple(words[at - n + 1 : at + 1]) == phrase:
                out.append((at - n + 1, label))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, base places (n_base, first_word, last_word, base_labels), labels, score, spans for each row of docs.

    labels: the base labels and those of the detections that stay; score: the likelihood that at least one detection is right, a base
    place counting 0.6, rounded to 6 places. spans: start, end, label of the detections, in characters of the lower-cased text. Only
    texts that hold a keyword go to the rules, whole. A null text counts as empty; rows that repeat get equal results.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.translate(t, UPPER, LOWER)
    gate = functools.reduce(lambda a, b: a | b, [low.contains(k) for k in STEMS]) | low.rlike(PLACES)
    words = re.compile(WORD)
    schema = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"

    def look(text: str | None) -> tuple:
        low = (text or "").translate(_FOLD)
        base = base_places(words.findall(low)) if "license" in low else []
        found = detect(low)
        miss = 0.4 if base else 1.0
        for f in found:
            miss *= 1 - f[4]
        first = min((b[0] for b in base), default=None)
        last = max((b[0] for b in base), default=None)
        own = {b[1] for b in base}
        spans = [{"start": s, "end": e, "label": k} for s, e, _, k, _ in found]
        return len(base), first, last, ",".join(sorted(own)), ",".join(sorted(own | {f[3] for f in found})), round(1 - miss, 6), spans

    @F.pandas_udf(schema)
    def rule(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nothing = (0, None, None, "", "", 0.0, [])
        for s in texts:
            rows = [look(x) if x is not None else nothing for x in s]
            out = pd.DataFrame(rows, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    n = F.regexp_count(t, F.lit(WORD_ANY_CASE)).cast("long")
    return docs.select("doc_id", n.alias("n_words"), rule(F.when(gate, t)).alias("r")).select("doc_id", "n_words", "r.*")


def op8_license_rules(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))
