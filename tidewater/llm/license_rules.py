"""License scans by ordered signature rules.

Texts become words (lower-cased ASCII; runs of digits, letters and bytes beyond ASCII).  Base phrases
are counted on every word of every text by the words' hashes.  Texts that hold a gate word, or a verb
of granting before "under", are scanned further: a rule runs only if a keyword of its own occurs, over
the words joined by single spaces.  Each match is an interval of words with the rule's label, priority
and confidence.  In order of priority (then longer, then earlier, then by place in the list) a match
stands unless it lies within one that stands already, so the specific rules suppress the general ones
that they contain; base places stand always.

There are written signatures of license texts and notices, and for every license of the list an
identifier, a grant and a bare mention of its written name or SPDX id, as regexes over words.  The
score is one minus the product of one minus the confidence over the standing labels, at most 1.

Null and empty texts have no words, no places and empty labels, and score 0.  Very long texts are
scanned whole: each rule's search is linear in the text and each match costs a logarithm.  Of equal
matches of two labels the earlier rule's stands.  Repeated rows are scanned each; extra columns are
ignored, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tables
from .textcore import ALNUM, LOWER, U64, row_slices, string_buffer, word_hash, words

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_CONFIDENCE = 0.9

# Label, keyword, and a regex for the license's name in words.
NAMES = [
    ("agpl-3", "affero|agpl", r"(?:gnu )?affero (?:gnu )?general public licen[cs]e(?: version| v)? ?3|agpl ?v?3(?: 0)?"),
    ("lgpl-3", "lesser|lgpl", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3|lgpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser|lgpl", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2(?: 1)?|lgpl ?v?2(?: 1)?"),
    ("gpl-3", "general public|gpl", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3|(?:gnu )?gpl ?v?3(?: 0)?"),
    ("gpl-2", "general public|gpl", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2|(?:gnu )?gpl ?v?2(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("apache-2", "apache", r"apache(?: software)? licen[cs]e(?: version)?(?: v)? ?2(?: 0)?|apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? ?1 1"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit", "mit", r"mit licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1(?: 1)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e"),
    ("cpl", "common public", r"common public licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("eupl", "eupl", r"eupl(?: v?1 [0-2])?"),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"(?:perl )?artistic licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl|fuck", r"wtfpl|do what the fuck you want to public licen[cs]e"),
    ("python", "python|psf", r"python software foundation licen[cs]e|psf licen[cs]e"),
    ("php", "php", r"php licen[cs]e(?: version)?(?: 3 0[01]?)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 [01])?"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by", "attribution", r"open data commons attribution licen[cs]e"),
    ("pddl", "dedication", r"(?:open data commons )?public domain dedication(?: and licen[cs]e)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("ibm-pl", "ibm", r"ibm public licen[cs]e"),
    ("apsl", "apple", r"apple public source licen[cs]e"),
    ("qpl", "q public", r"q public licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat(?: public)? licen[cs]e"),
    ("bsl", "business", r"business source licen[cs]e(?: 1 1)?"),
    ("sspl", "server side", r"server side public licen[cs]e"),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: version)?(?: 2(?: 0)?)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[cs]e"),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?"),
    ("llama", "llama", r"llama [234](?: [0-9])? community licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "zero", r"creative commons zero"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?derivatives"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?derivatives"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("cc", "creative", r"creative commons(?: licen[cs]e)?"),
    ("public-domain", "public domain", r"public domain"),
    ("afl", "academic", r"academic free licen[cs]e(?: version)?(?: [123] [01])?"),
    ("osl", "open software", r"open software licen[cs]e(?: version)?(?: [123] 0)?"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: licen[cs]e)?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v?2)?"),
    ("upl", "universal", r"universal permissive licen[cs]e"),
    ("blue-oak", "blue oak", r"blue oak model licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e"),
    ("json", "json", r"json licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e|mit x11"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e"),
    ("unicode", "unicode", r"unicode (?:terms of use|licen[cs]e)"),
]

# SPDX ids, or what stands for them in a grant, by label; as words.
IDS = {
    "agpl-3": "agpl 3 0", "lgpl-3": "lgpl 3 0", "lgpl-2.1": "lgpl 2 1", "gpl-3": "gpl 3 0", "gpl-2": "gpl 2 0", "gfdl": "gfdl 1 [1-3]", "apache-2": "apache 2 0",
    "apache-1.1": "apache 1 1", "mit": "mit", "mit-0": "mit 0", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause", "bsd-4": "bsd 4 clause", "0bsd": "0bsd", "isc": "isc",
    "mpl-2": "mpl 2 0", "mpl-1.1": "mpl 1 1", "epl-2": "epl 2 0", "epl-1": "epl 1 0", "cddl": "cddl 1 [01]", "cpl": "cpl 1 0", "eupl": "eupl 1 [0-2]", "artistic-2": "artistic 2 0",
    "artistic-1": "artistic 1 0", "zlib": "zlib", "boost": "bsl 1 0", "unlicense": "unlicense", "wtfpl": "wtfpl", "python": "psf 2 0|python 2 0", "php": "php 3 0[01]?", "ruby": "ruby",
    "postgresql": "postgresql", "openssl": "openssl", "ncsa": "ncsa", "ofl": "ofl 1 [01]", "odbl": "odbl 1 0", "odc-by": "odc by 1 0", "pddl": "pddl 1 0", "ms-pl": "ms pl",
    "ms-rl": "ms rl", "ibm-pl": "ipl 1 0", "apsl": "apsl [12] [0-2]", "qpl": "qpl 1 0", "sleepycat": "sleepycat", "bsl": "busl 1 1", "sspl": "sspl 1 0", "elastic-2": "elastic 2 0",
    "cc0": "cc0 1 0", "cc-by-nc-nd": "cc by nc nd [1-4] [05]", "cc-by-nc-sa": "cc by nc sa [1-4] [05]", "cc-by-nc": "cc by nc [1-4] [05]", "cc-by-nd": "cc by nd [1-4] [05]",
    "cc-by-sa": "cc by sa [1-4] [05]", "cc-by": "cc by [1-4] [05]", "afl": "afl [123] [01]", "osl": "osl [123] [01]", "cecill": "cecill [12] [01]|cecill [bc]", "mulan": "mulanpsl [12] 0",
    "upl": "upl 1 0", "blue-oak": "blueoak 1 0 0", "json": "json", "vim": "vim", "x11": "x11", "w3c": "w3c", "unicode": "unicode 3 0|unicode dfs 20[0-9]{2}|unicode tou",
}

# Label, keyword, signature and confidence of license texts and notices, as words.
SIGNATURES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0.99),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.97),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.9),
    ("ncsa", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80}? to deal with the software without restriction", 0.97),
    ("json", "evil", r"the software shall be used for good not evil", 0.99),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.99),
    ("isc", "permission", r"provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("bsd-3", "endorse", r"redistribution and use in source and binary forms .{0,900}? neither the name of .{0,300}? endorse or promote", 0.99),
    ("bsd-3", "endorse", r"neither the name of .{0,200}? may be used to endorse or promote products derived from this software", 0.97),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.99),
    ("bsd-2", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions", 0.93),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.93),
    ("agpl-3", "affero", r"gnu affero general public licen[cs]e version 3 19 november 2007", 0.99),
    ("agpl-3", "affero", r"the gnu affero general public licen[cs]e is a free copyleft licen[cs]e", 0.99),
    ("gpl-3", "gnu", r"gnu general public licen[cs]e version 3 29 june 2007", 0.99),
    ("gpl-3", "copyleft", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", 0.99),
    ("gpl-2", "gnu", r"gnu general public licen[cs]e version 2 june 1991", 0.99),
    ("gpl-1", "gnu", r"gnu general public licen[cs]e version 1 february 1989", 0.99),
    ("lgpl-3", "gnu", r"gnu lesser general public licen[cs]e version 3 29 june 2007", 0.99),
    ("lgpl-2.1", "gnu", r"gnu lesser general public licen[cs]e version 2 1 february 1999", 0.99),
    ("lgpl-2", "gnu", r"gnu library general public licen[cs]e version 2 june 1991", 0.99),
    ("gfdl", "gnu", r"gnu free documentation licen[cs]e version 1 [1-3]", 0.99),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 0.99),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 0.98),
    ("agpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 0.98),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it", 0.98),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 0.9),
    ("gpl", "licenses", r"the licenses for most software are designed to take away your freedom to share and change it", 0.98),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[cs]e along with this program", 0.97),
    ("lgpl", "gnu", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this", 0.97),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.95),
    ("apache-2", "apache", r"apache licen[cs]e version 2 0 january 2004", 0.99),
    ("apache-2", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) licen[cs]e", 0.98),
    ("apache-2", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 0.95),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 0.9),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 0.99),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 0.97),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e version 2 0 1 definitions", 0.99),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 0.99),
    ("epl-2", "eclipse", r"made available under the terms of the eclipse public licen[cs]e (?:v )?2 0", 0.98),
    ("epl-1", "eclipse", r"made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0", 0.98),
    ("epl", "eclipse", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e", 0.98),
    ("cpl", "accompanying", r"the accompanying program is provided under the terms of this common public licen[cs]e", 0.98),
    ("ibm-pl", "accompanying", r"the accompanying program is provided under the terms of this ibm public licen[cs]e", 0.98),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 0.99),
    ("eupl", "eupl", r"this european union public licen[cs]e the eupl applies to the work", 0.99),
    ("eupl", "eupl", r"licensed under the eupl version 1 [12]", 0.98),
    ("artistic-1", "semblance", r"conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 0.98),
    ("artistic-1", "intent", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic-2", "establishes", r"this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed", 0.98),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction", 0.95),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event", 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.97),
    ("zlib", "misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.97),
    ("libpng", "libpng", r"this copy of the libpng notices is provided for your convenience", 0.97),
    ("boost", "boost", r"distributed under the boost software licen[cs]e version 1 0", 0.99),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.98),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.99),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.97),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 0.99),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed", 0.97),
    ("beerware", "retain", r"as long as you retain this notice you can do whatever you want with this stuff", 0.98),
    ("python", "psf", r"this licen[cs]e agreement is between the python software foundation psf", 0.99),
    ("python", "beopen", r"this licen[cs]e agreement is between beopen com", 0.98),
    ("php", "php", r"this product includes php software freely available from", 0.97),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.98),
    ("tcl", "hereby", r"the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation", 0.97),
    ("curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that", 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 0.97),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", 0.97),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 0.97),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 0.99),
    ("x11", "advertising", r"except as contained in this notice the names? of .{0,80}? shall not be used in advertising", 0.93),
    ("w3c", "obtaining", r"by obtaining (?:using )?and or copying this work you the licensee agree that you have read understood and will comply", 0.97),
    ("unicode", "unicode", r"unicode inc licen[cs]e agreement data files and software", 0.99),
    ("sgi", "sgi", r"sgi free software licen[cs]e b version 2 0", 0.98),
    ("ofl", "sil", r"this font software is licensed under the sil open font licen[cs]e", 0.99),
    ("ofl", "sil", r"sil open font licen[cs]e version 1 1 26 february 2007", 0.99),
    ("lppl", "latex", r"under the conditions of the latex project public licen[cs]e", 0.98),
    ("ecl-2", "educational", r"educational community licen[cs]e version 2 0", 0.97),
    ("odbl", "odbl", r"the open database licen[cs]e odbl is a licen[cs]e agreement intended to allow users to freely share modify and use this database", 0.99),
    ("odbl", "database", r"made available under the open database licen[cs]e", 0.97),
    ("odc-by", "commons", r"the open data commons attribution licen[cs]e is a licen[cs]e agreement intended to allow users to freely share", 0.99),
    ("pddl", "dedication", r"the open data commons public domain dedication and licen[cs]e is a document intended to allow you to freely share", 0.99),
    ("ms-pl", "governs", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", 0.93),
    ("apsl", "modifications", r"this file contains original code and or modifications of original code .{0,60}? apple public source licen[cs]e", 0.98),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 0.97),
    ("bsl", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 0.99),
    ("bsl", "anniversary", r"effective on the change date or the fourth anniversary of the first publicly available distribution", 0.98),
    ("sspl", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service", 0.98),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service", 0.98),
    ("commons-clause", "grant", r"the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software", 0.98),
    ("polyform", "licensor", r"the licensor grants you a copyright licen[cs]e for the software to do everything you might do with the software that would otherwise infringe", 0.97),
    ("openrail", "restrictions", r"use based restrictions as referenced in paragraph", 0.9),
    ("openrail", "derivatives", r"you agree not to use the model or derivatives of the model", 0.95),
    ("llama", "llama", r"llama [234](?: [0-9])? community licen[cs]e agreement", 0.99),
    ("llama", "llama", r"built with (?:meta )?llama(?: [234])?", 0.86),
    ("gemma", "gemma", r"gemma is provided under and subject to the gemma terms of use", 0.98),
    ("cc0", "waived", r"has waived all copyright and related or neighboring rights", 0.97),
    ("cc0", "unconditionally", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 0.99),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 0.98),
    ("cc", "creative", r"the work as defined below is provided under the terms of this creative commons public licen[cs]e", 0.97),
    ("cc", "creative", r"you accept and agree to be bound by the terms and conditions of this creative commons", 0.97),
    ("cc-by", "credit", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", 0.93),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original", 0.97),
    ("cc-by-nd", "remix", r"if you remix transform or build upon the material you may not distribute the modified material", 0.97),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes", 0.95),
    ("cc-by-sa", "contributions", r"user contributions licensed under cc by sa", 0.97),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? licen[cs]e under french law", 0.99),
    ("mulan", "mulan", r"you can use this software according to the terms and conditions of the mulan psl", 0.99),
    ("upl", "upl", r"the universal permissive licen[cs]e upl version 1 0", 0.99),
    ("blue-oak", "contributors", r"this licen[cs]e gives everyone as much permission to work with this software as possible while protecting contributors from liability", 0.98),
    ("hippocratic", "declaration", r"the software may not be used by .{0,200}? universal declaration of human rights", 0.95),
    ("vim", "unmodified", r"there are no restrictions on distributing unmodified copies of vim", 0.98),
    ("ogl-uk", "government", r"contains public sector information licensed under the open government licen[cs]e", 0.97),
    ("etalab", "ouverte", r"licence ouverte open licence", 0.95),
    ("unsplash", "unsplash", r"unsplash grants you an irrevocable nonexclusive worldwide copyright licen[cs]e", 0.97),
    ("gutenberg", "gutenberg", r"under the terms of the project gutenberg licen[cs]e included with this e ?book", 0.98),
    ("warranty", "warranty", r"(?:without|no) warranty of any kind", 0.3),
    ("warranty", "merchantability", r"implied warranty of merchantability or fitness for a particular purpose", 0.4),
    ("proprietary", "reserved", r"all rights reserved", 0.5),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("proprietary", "prohibited", r"(?:unauthori[sz]ed (?:copying|use|reproduction|distribution)|copying of this file) .{0,60}?prohibited", 0.8),
    ("proprietary", "publication", r"no part of this publication may be reproduced(?: distributed)?(?: or)?(?: transmitted)? in any form or by any means", 0.8),
    ("proprietary", "written", r"may not be (?:reproduced|copied|redistributed) .{0,60}?without (?:the )?(?:prior |express )*written (?:permission|consent)", 0.8),
    ("proprietary", "reproduction", r"reproduction in whole or in part .{0,60}?prohibited", 0.8),
    ("proprietary", "confidential", r"this (?:document|file) contains confidential(?: and proprietary)? information", 0.7),
    ("proprietary", "secrets", r"contains trade secrets", 0.7),
    ("evaluation", "evaluation", r"for evaluation purposes only", 0.6),
    ("personal-use", "personal", r"for personal (?:and )?non ?commercial use only", 0.7),
    ("research-use", "research", r"for (?:academic )?research purposes only", 0.6),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes) only", 0.7),
    ("no-derivatives", "derivative", r"no derivative works (?:are )?(?:allowed|permitted)", 0.6),
    ("no-training", "train|training", r"may not be used (?:to train|for (?:the )?training|in (?:the )?training) .{0,60}?(?:models?|machine learning|artificial intelligence)", 0.8),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 0.4),
    ("takedown", "digital", r"digital millennium copyright act", 0.5),
]

GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|shared|used|offered)(?: to you)? under (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?"
IDENTIFIER = r"spdx licen[cs]e identifier (?:[a-z0-9 ]{1,80}? (?:or|and|with) )?"


class Rule:
    """A label with its keywords, of which one must occur, the pattern, priority (lower first) and confidence.

    Of a pattern with a group named id the interval is that group, so ids in one expression don't
    contain each other.
    """

    __slots__ = ("label", "keywords", "pattern", "priority", "confidence", "group")

    def __init__(self, label: str, keyword: str, pattern: str, priority: int, confidence: float):
        self.label, self.keywords, self.priority, self.confidence = label, tuple(keyword.encode().split(b"|")), priority, confidence
        self.pattern = re.compile(rf"(?<= )(?:{pattern})(?= )".encode(), re.DOTALL)
        self.group = "id" if "id" in self.pattern.groupindex else 0


def _rules() -> list[Rule]:
    """Texts of licenses first, then identifiers, grants and bare names, and loose notices last."""
    certain = [x for x in SIGNATURES if x[3] >= 0.85]
    out = [Rule(label, keyword, pattern, k, confidence) for k, (label, keyword, pattern, confidence) in enumerate(certain)]
    for rank, form, confidence, gate in ((1, IDENTIFIER, 0.99, "spdx"), (2, GRANT, 0.95, "under")):
        out += [Rule(label, gate, f"{form}(?P<id>{x})", 1000 * rank, confidence) for label, x in IDS.items()]
        out += [Rule(label, keyword, f"{form}(?:{name})", 1000 * rank + 500 + k, confidence) for k, (label, keyword, name) in enumerate(NAMES)]
    out += [Rule(label, keyword, name, 3000 + k, 0.6) for k, (label, keyword, name) in enumerate(NAMES)]
    return out + [Rule(label, keyword, pattern, 4000 + k, confidence) for k, (label, keyword, pattern, confidence) in enumerate(x for x in SIGNATURES if x[3] < 0.85)]


RULES = _rules()

# Words of which every match of a name contains one.  A signature's match contains the
# first word of one of its keywords, an identifier's the word spdx.
GATE_WORDS = """license licence licensed licenced spdx gpl gpl2 gpl3 gplv2 gplv3 agpl agpl3 agplv3 lgpl lgpl2 lgpl3 lgplv2 lgplv3
apache bsd freebsd 0bsd cddl eupl wtfpl unlicense openrail rail cc cc0 commons domain cecill mulan x11 unicode dedication"""
GRANTING = "licensed licenced released distributed available provided published shared used offered you"


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, dtype=bool)
    out[(hashes & U64(0xFFFF)).astype(np.int64)] = True
    return out


_GATES = np.array(sorted(word_hash(w) for w in {*GATE_WORDS.split(), *(k.split()[0] for x in SIGNATURES for k in x[1].split("|"))}), U64)
_GATE_MAP = _bitmap(_GATES)
_GRANTING, _UNDER = np.array([word_hash(w) for w in GRANTING.split()], U64), U64(word_hash("under"))
_PHRASES = [([word_hash(w) for w in phrase.split()], label) for phrase, label in BASE.items()]


def base_places(hashes: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, int, str]]:
    """For each base phrase the words where it begins, its words, and its label."""
    out = []
    for phrase, label in _PHRASES:
        n = len(phrase)
        if len(hashes) < n:
            out.append((np.zeros(0, np.int64), n, label))
            continue
        at = np.flatnonzero(hashes[: len(hashes) - n + 1] == U64(phrase[0]))
        for k in range(1, n):
            at = at[(hashes[at + k] == U64(phrase[k])) & (row[at + k] == row[at])]
        out.append((at, n, label))
    return out


_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def matches(text: bytes) -> list[tuple[int, int, Rule]]:
    """Standing matches in lower-cased text: first word, word after the last, rule."""
    joined = b" " + b" ".join(_WORDS.findall(text)) + b" "
    present: dict[bytes, bool] = {}
    found = []
    for rule in RULES:
        if not any(present[k] if k in present else present.setdefault(k, k in joined) for k in rule.keywords):
            continue
        found += [(*m.span(rule.group), rule) for m in rule.pattern.finditer(joined)]
    if not found:
        return []
    found.sort(key=lambda x: (x[2].priority, x[0] - x[1], x[0]))
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = sorted({a for a, _, _ in found})
    reach = _PrefixMaximum(len(begins))
    standing: list[tuple[int, int, Rule]] = []
    for a, b, rule in found:
        at = bisect_left(begins, a)
        if reach.get(at) < b:
            reach.put(at, b)
            standing.append((a, b, rule))
    first = np.searchsorted(spaces, [a for a, _, _ in standing]) - 1
    last = np.searchsorted(spaces, [b for _, b, _ in standing])
    return [(int(a), int(b), rule) for a, b, (_, _, rule) in zip(first, last, standing, strict=True)]


class _PrefixMaximum:
    """The largest value put at a place or before it, in a Fenwick tree."""

    def __init__(self, size: int):
        self.tree = [-1] * (size + 1)

    def put(self, at: int, value: int) -> None:
        at += 1
        while at < len(self.tree):
            self.tree[at] = max(self.tree[at], value)
            at += at & -at

    def get(self, at: int) -> int:
        at, out = at + 1, -1
        while at:
            out = max(out, self.tree[at])
            at -= at & -at
        return out


NAMES_OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = string_buffer(batch.column(1))
        rows: list[tuple] = []
        for a, b in row_slices(offs):
            own, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            w = words(own, at, ALNUM)
            row = np.repeat(np.arange(b - a), np.diff(w.first))
            places: dict[int, list[tuple[int, str]]] = {}
            for begin, _, label in base_places(w.hash, row):
                for p in begin.tolist():
                    places.setdefault(int(row[p]), []).append((p - int(w.first[row[p]]), label))
            low = LOWER[own].tobytes()
            count = np.diff(w.first).tolist()
            gated = _gated(w.hash, row)
            for i in range(b - a):
                base = places.get(i, [])
                confidence: dict[str, float] = {label: BASE_CONFIDENCE for _, label in base}
                for _, _, rule in matches(low[at[i] : at[i + 1]]) if i in gated or base else ():
                    confidence[rule.label] = max(confidence.get(rule.label, 0.0), rule.confidence)
                score = 1.0
                for label in sorted(confidence):
                    score *= 1 - confidence[label]
                starts = [p for p, _ in base]
                rows.append((count[i], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(confidence)), 1 - score))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *NAMES_OUT])


def _gated(hashes: np.ndarray, row: np.ndarray) -> set[int]:
    """Rows that hold a gate word, or a verb of granting before the word under."""
    at = np.flatnonzero(_GATE_MAP[(hashes & U64(0xFFFF)).astype(np.int64)])
    under = np.flatnonzero(hashes[1:] == _UNDER)
    granted = under[np.isin(hashes[under], _GRANTING) & (row[under] == row[under + 1])]
    return {*row[at[np.isin(hashes[at], _GATES)]].tolist(), *row[granted].tolist()}


def scan(documents: DataFrame) -> DataFrame:
    """Words, base places and labels, all labels and score of every row."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables.read(spark, sf_dir, "documents"))
