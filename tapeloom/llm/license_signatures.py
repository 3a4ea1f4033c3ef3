"""Hand-written signature rules of license_rules.py.

A rule is (label, keywords, pattern, example). Patterns run over lower-case words with one space between; every text a pattern matches holds one of
the keywords as a word. A pattern without an example is its own example. Groups give priority and weight of evidence.
"""

from __future__ import annotations

#: Sentences of the licences themselves and their standard grants.
GRANTS = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", None),
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all(?: copies or substantial portions of the software)?", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", None),
    ("x11", "advertising", r"except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", None),
    ("bsd-3-clause", "contributors", r"neither the names? of .{1,80}? (?:nor|and) (?:the names of )?(?:its|their) contributors may be used to endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2-clause", "freebsd", r"those of the authors and should not be interpreted as representing official policies either expressed or implied of the freebsd project", None),
    ("bsd-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license", None),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", None),
    ("isc", "permission", r"permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", None),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", None),
    ("zlib", "permission", r"permission is granted to anyone to use this software for any purpose including commercial applications", None),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", None),
    ("boost-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", None),
    ("gpl-family", "redistribute", r"this (?:program|file|package|library|software) is free software you can redistribute it and or modify it", "this program is free software you can redistribute it and or modify it"),
    ("gpl-family", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license", None),
    ("gpl-2.0-or-later", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0-only", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl-family", "gnu", r"you should have received a copy of the gnu general public license along with this (?:program|file|library|package|software)", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-family", "warranty", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness", None),
    ("lgpl-family", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|file|library|package|software)", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl-2.1-or-later", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", "redistribute", r"redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version", "redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-family", "affero", r"you should have received a copy of the gnu affero general public license along with this (?:program|file|package|software)", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0-or-later", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", None),
    ("gpl-family", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", None),
    ("gpl-2.0", "gnu", r"gnu general public license version 2 june 1991", None),
    ("gpl-3.0", "june", r"gnu general public license version 3 29 june 2007", None),
    ("lgpl-2.1", "february", r"gnu lesser general public license version 2 1 february 1999", None),
    ("agpl-3.0", "november", r"gnu affero general public license version 3 19 november 2007", None),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements", None),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", None),
    ("apache-2.0", "limitations", r"see the license for the specific language governing permissions and limitations under the license", None),
    ("apache-2.0", "january", r"apache license version 2 0 january 2004", None),
    ("apache-family", "apache", r"this product includes software developed (?:by|at) the apache software foundation", "this product includes software developed at the apache software foundation"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", None),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", None),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", None),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", None),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0", None),
    ("epl-1.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license v ?1 0", "accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license(?: v ?)? ?2 0", "accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license", None),
    ("cc-by-4.0", "attribution", r"this work is licensed under a creative commons attribution 4 0 international license", None),
    ("cc-by-sa-4.0", "sharealike", r"this work is licensed under a creative commons attribution sharealike 4 0 international license", None),
    ("cc-by-nc-4.0", "noncommercial", r"this work is licensed under a creative commons attribution noncommercial 4 0 international license", None),
    ("cc-by-nd-4.0", "noderivatives", r"this work is licensed under a creative commons attribution noderivatives 4 0 international license", None),
    ("cc-by-nc-sa-4.0", "noncommercial", r"this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", None),
    ("cc-by-nc-nd-4.0", "noncommercial", r"this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", None),
    ("cc0-1.0", "waived", r"to the extent possible under law .{1,80}? (?:has|have) waived all copyright and related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "dedicated", r"dedicated all copyright and related and neighboring rights to this (?:software|work) to the public domain", "dedicated all copyright and related and neighboring rights to this software to the public domain"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", None),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software", None),
    ("wtfpl", "license", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", None),
    ("wtfpl", "want", r"you just do what the f\w+ you want to", "you just do what the foo you want to"),
    ("artistic-2.0", "artistic", r"you may distribute (?:it|this (?:program|package)) under the terms of the artistic license(?: version)? 2 0", "you may distribute this package under the terms of the artistic license version 2 0"),
    ("perl-5", "perl", r"you can redistribute it and or modify it under the same terms as perl itself", None),
    ("perl-5", "perl", r"(?:free software|may be used|is available|licensed) under the same terms as perl(?: 5)?", "licensed under the same terms as perl 5"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1", None),
    ("ofl-1.1", "font", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", None),
    ("odbl-1.0", "database", r"this (?:.{1,60} )?database is made available under the open database license", "this example database is made available under the open database license"),
    ("odc-by-1.0", "commons", r"this (?:.{1,60} )?is made available under the open data commons attribution license", "this example is made available under the open data commons attribution license"),
    ("pddl-1.0", "dedication", r"this (?:.{1,60} )?is made available under the (?:open data commons )?public domain dedication and license", "this example is made available under the open data commons public domain dedication and license"),
    ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license", None),
    ("psf-2.0", "python", r"psf is making python available to licensee on an as is basis", None),
    ("psf-2.0", "python", r"this license agreement is between the python software foundation", None),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", None),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", None),
    ("curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies except as contained", None),
    ("libpng", "png", r"the png reference library is supplied as is", None),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", None),
    ("freetype", "freetype", r"portions of this software are copyright (?:c )?(?:\d{4} )?the freetype project", "portions of this software are copyright 2020 the freetype project"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", None),
    ("icu", "unicode", r"copyright (?:c )?(?:\d{4} )*(?:and later )?unicode inc and others", "copyright c 2016 and later unicode inc and others"),
    ("w3c", "royalty", r"permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("postgresql", "agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", None),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text", None),
    ("tcl", "hereby", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", None),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer(?: in return)?", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "evil", r"the software shall be used for good not evil", None),
    ("upl-1.0", "condition", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", None),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license", None),
    ("blueoak-1.0", "contributor", r"each contributor licenses you to do everything with this software that would otherwise infringe", None),
    ("busl-1.1", "nonproduction|production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non ?production use of the licensed work", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service", None),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available", None),
    ("commons-clause", "license", r"the license does not grant to you the right to sell the software", None),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version)? 1 2(?: or as soon they will be approved by the european commission subsequent versions of the eupl)?", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("mulan-psl-2.0", "mulan", r"is licensed under mulan psl ?v2", "is licensed under mulan psl v2"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? license under french law", "this software is governed by the cecill b license under french law"),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3 0", None),
    ("osl-3.0", "licensed", r"licensed under the open software license version 3 0", None),
    ("ecl-2.0", "educational", r"licensed under the educational community license version 2 0", None),
    ("nasa-1.3", "nasa", r"nasa open source agreement version 1 3", None),
    ("bigscience-rail", "responsible", r"(?:bigscience|creativeml) (?:open )?rail(?: m)? responsible", "creativeml open rail m responsible"),
    ("llama-community", "llama", r"llama (?:\d )?(?:\d )?is licensed under the llama (?:\d )?(?:\d )?community license", "llama 3 1 is licensed under the llama 3 1 community license"),
)

#: Headers and sentences that point to a licence by name.
HEADERS = (
    ("mit", "licensed|licenced", r"licen[cs]ed under (?:the )?(?:terms of the )?mit(?: x11)?(?: licen[cs]e)?", "licensed under the terms of the mit license"),
    ("mit", "license|licence", r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of the )?mit(?: x11)? licen[cs]e", "released under the mit license"),
    ("mit", "license|licence", r"(?:use of this (?:source )?code|this (?:source )?code|this (?:software|project|package)) is (?:governed|covered) by (?:an|the) mit(?: style)? licen[cs]e", "use of this source code is governed by an mit style license"),
    ("mit", "license|licence", r"subject to the (?:terms of the )?mit licen[cs]e", "subject to the terms of the mit license"),
    ("mit", "license|licence", r"see the mit licen[cs]e for (?:more )?details", "see the mit license for details"),
    ("bsd", "licensed|licenced", r"licen[cs]ed under (?:the |a )?(?:terms of the )?(?:(?:new|modified|simplified|revised) )?bsd(?: style)?(?: licen[cs]e)?", "licensed under the new bsd license"),
    ("bsd", "license|licence", r"(?:released|distributed|published|available|provided) under (?:the |a )?(?:terms of the )?(?:(?:new|modified|simplified|revised) )?bsd(?: style)? licen[cs]e", "distributed under a bsd style license"),
    ("bsd", "license|licence", r"use of this source code is governed by a bsd style licen[cs]e", "use of this source code is governed by a bsd style license"),
    ("bsd-2-clause", "licensed|licenced", r"licen[cs]ed under (?:the )?(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "licensed under the bsd 2 clause license"),
    ("bsd-3-clause", "licensed|licenced", r"licen[cs]ed under (?:the )?(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "licensed under the 3 clause bsd license"),
    ("isc", "licensed|licenced", r"licen[cs]ed under (?:the )?(?:terms of the )?isc(?: licen[cs]e)?", "licensed under the isc license"),
    ("isc", "license|licence", r"(?:released|distributed|published|available|provided) under (?:the )?isc licen[cs]e", "released under the isc license"),
    ("apache-2.0", "apache", r"licen[cs]ed under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version)? v?2(?: 0)?(?: licen[cs]e)?", "licensed under the apache 2 0 license"),
    ("apache-2.0", "apache", r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version)? v?2(?: 0)?(?: licen[cs]e)?", "released under the apache license version 2 0"),
    ("apache-2.0", "apache", r"subject to the (?:terms of the )?apache(?: licen[cs]e)?(?: version)? 2 0", "subject to the terms of the apache license version 2 0"),
    ("apache-family", "apache", r"(?:licen[cs]ed|released|distributed) under (?:the )?apache(?: software)? licen[cs]e", "licensed under the apache license"),
    ("gpl-2.0", "gpl", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl (?:v|version )?2(?: 0)?(?: only)?", "licensed under the gnu gpl v2"),
    ("gpl-3.0", "gpl", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl (?:v|version )?3(?: 0)?(?: only)?", "released under the gpl version 3"),
    ("gpl-2.0", "gplv2", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?gplv2", "released under the gnu gplv2"),
    ("gpl-3.0", "gplv3", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?gplv3", "available under the gplv3"),
    ("gpl-family", "gpl", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl", "distributed under the gpl"),
    ("gpl-family", "gnu", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e", "released under the gnu general public license"),
    ("gpl-family", "gnu", r"under the terms of the gnu general public licen[cs]e", "under the terms of the gnu general public license"),
    ("gpl-family", "gnu", r"see the gnu general public licen[cs]e for more details", "see the gnu general public license for more details"),
    ("gpl-2.0", "gnu", r"under the terms of (?:version 2 of the gnu general public licen[cs]e|the gnu general public licen[cs]e version 2)", "under the terms of version 2 of the gnu general public license"),
    ("gpl-3.0", "gnu", r"under the terms of (?:version 3 of the gnu general public licen[cs]e|the gnu general public licen[cs]e version 3)", "under the terms of the gnu general public license version 3"),
    ("lgpl-family", "gnu", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e", "under the terms of the gnu lesser general public license"),
    ("lgpl-family", "lgpl", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?lgpl", "licensed under the gnu lgpl"),
    ("lgpl-2.1", "lgpl|lgplv2", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|lgplv2) (?:v2 |version 2 |2 )?1", "licensed under the lgpl version 2 1"),
    ("lgpl-3.0", "lgpl", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?lgpl (?:v3|version 3|3)", "released under the lgpl v3"),
    ("agpl-family", "affero", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e", "licensed under the gnu affero general public license"),
    ("agpl-family", "agpl|agplv3", r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:gnu )?agpl(?:v3)?", "available under the agplv3"),
    ("gfdl", "documentation", r"under the (?:terms of the )?gnu free documentation licen[cs]e", "under the terms of the gnu free documentation license"),
    ("gfdl", "gfdl|fdl", r"(?:licen[cs]ed|released|available) under (?:the )?(?:gnu )?(?:fdl|gfdl)(?: gfdl)?", "available under the gfdl"),
    ("mpl-family", "mozilla", r"(?:licen[cs]ed|released|distributed|subject to the terms|available) (?:under|of) (?:the )?(?:terms of the )?mozilla public licen[cs]e", "licensed under the mozilla public license"),
    ("mpl-family", "mpl", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?mpl", "licensed under the mpl"),
    ("epl-family", "eclipse", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?eclipse public licen[cs]e", "available under the terms of the eclipse public license"),
    ("epl-family", "epl", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?epl", "released under the epl"),
    ("cddl-family", "cddl", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?cddl", "licensed under the cddl"),
    ("cpl-1.0", "license|licence", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?common public licen[cs]e", "available under the terms of the common public license"),
    ("artistic-family", "artistic", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?artistic licen[cs]e", "released under the artistic license"),
    ("boost-1.0", "boost", r"distributed under the boost software licen[cs]e version 1 0", "distributed under the boost software license version 1 0"),
    ("boost-1.0", "boost", r"(?:licen[cs]ed|released|available) under (?:the )?boost(?: software)? licen[cs]e", "licensed under the boost software license"),
    ("zlib", "zlib", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?zlib(?: libpng)?(?: licen[cs]e)?", "released under the zlib license"),
    ("psf-2.0", "python", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:python software foundation|psf python) licen[cs]e", "licensed under the python software foundation license"),
    ("postgresql", "postgresql", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?postgresql licen[cs]e", "released under the postgresql license"),
    ("unlicense", "unlicense", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?unlicense", "released under the unlicense"),
    ("wtfpl", "wtfpl", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?wtfpl", "licensed under the wtfpl"),
    ("cc0-1.0", "cc0", r"(?:licen[cs]ed|released|distributed|available|dedicated) (?:under|using) (?:the )?(?:creative commons )?cc0", "released under the cc0"),
    ("cc-by-sa", "creative|cc", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?(?:creative commons attribution share ?alike|cc by sa)", "available under a creative commons attribution share alike"),
    ("cc-by-nc", "creative|cc", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?(?:creative commons attribution non ?commercial|cc by nc)", "released under a creative commons attribution non commercial"),
    ("cc-by-nd", "creative|cc", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?(?:creative commons attribution (?:no ?derivatives|noderivs)|cc by nd)", "released under a cc by nd"),
    ("cc-by-nc-sa", "creative|cc", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)", "licensed under a cc by nc sa"),
    ("cc-by-nc-nd", "creative|cc", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?(?:creative commons attribution non ?commercial no ?derivatives|cc by nc nd)", "licensed under a cc by nc nd"),
    ("cc-by-family", "creative", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?creative commons attribution", "licensed under a creative commons attribution"),
    ("creative-commons", "creative", r"(?:licen[cs]ed|released|distributed|available) under (?:a |the )?creative commons licen[cs]e", "available under a creative commons license"),
    ("ofl", "font", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:sil )?open font licen[cs]e", "available under the sil open font license"),
    ("odbl", "odbl", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?odbl", "available under the odbl"),
    ("eupl", "eupl|european", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:european union public licen[cs]e|eupl)(?: eupl)?", "licensed under the eupl"),
    ("ms-pl", "microsoft", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?microsoft public licen[cs]e", "licensed under the microsoft public license"),
    ("ms-rl", "microsoft", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?microsoft reciprocal licen[cs]e", "licensed under the microsoft reciprocal license"),
    ("busl", "license|licence", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?business source licen[cs]e", "released under the business source license"),
    ("sspl-1.0", "sspl|server", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:server side public licen[cs]e|sspl)(?: sspl)?", "released under the sspl"),
    ("elastic", "elastic", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?elastic licen[cs]e", "available under the elastic license"),
    ("ogl-uk", "government", r"(?:contains public sector information )?licen[cs]ed under the open government licen[cs]e(?: v[123](?: 0)?)?", "contains public sector information licensed under the open government license v3 0"),
    ("gpl-mit-dual", "dual|dually", r"dual(?:ly)? licen[cs]ed under (?:the )?(?:mit (?:and|or) (?:the )?gpl|gpl (?:and|or) (?:the )?mit)", "dual licensed under the mit and gpl"),
    ("mit-apache-dual", "apache", r"(?:dual(?:ly)? )?licen[cs]ed under (?:either (?:of )?)?(?:the )?(?:mit or apache 2 0|apache 2 0 or mit|mit apache 2 0)", "licensed under either of the apache 2 0 or mit"),
    ("proprietary", "license|licence", r"(?:use|used) (?:only )?(?:under|in accordance with) the terms of (?:the|your) (?:commercial|end user) licen[cs]e(?: agreement)?", "used only under the terms of your commercial license agreement"),
)

#: Addresses of licence texts.
ADDRESSES = (
    ("apache-2.0", "apache", r"(?:www )?apache org licenses license 2 0(?: html| txt)?", "www apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"(?:www )?apache org licenses license 1 1", "apache org licenses license 1 1"),
    ("mit", "opensource", r"(?:www )?opensource org licenses? mit(?: license)?(?: php)?", "opensource org licenses mit"),
    ("bsd", "opensource", r"(?:www )?opensource org licenses? bsd(?: license)?(?: php)?", "opensource org licenses bsd license php"),
    ("bsd-2-clause", "opensource", r"(?:www )?opensource org licenses? bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"(?:www )?opensource org licenses? bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource", r"(?:www )?opensource org licenses? isc", "opensource org licenses isc"),
    ("apache-2.0", "opensource", r"(?:www )?opensource org licenses? apache 2 0", "opensource org licenses apache 2 0"),
    ("gpl-2.0", "opensource", r"(?:www )?opensource org licenses? gpl 2 0", "opensource org licenses gpl 2 0"),
    ("gpl-3.0", "opensource", r"(?:www )?opensource org licenses? gpl 3 0", "opensource org licenses gpl 3 0"),
    ("lgpl-2.1", "opensource", r"(?:www )?opensource org licenses? lgpl 2 1", "opensource org licenses lgpl 2 1"),
    ("lgpl-3.0", "opensource", r"(?:www )?opensource org licenses? lgpl 3 0", "opensource org licenses lgpl 3 0"),
    ("mpl-2.0", "opensource", r"(?:www )?opensource org licenses? mpl 2 0", "opensource org licenses mpl 2 0"),
    ("epl-1.0", "opensource", r"(?:www )?opensource org licenses? epl 1 0", "opensource org licenses epl 1 0"),
    ("epl-2.0", "opensource", r"(?:www )?opensource org licenses? epl 2 0", "opensource org licenses epl 2 0"),
    ("cddl-1.0", "opensource", r"(?:www )?opensource org licenses? cddl 1 0", "opensource org licenses cddl 1 0"),
    ("artistic-2.0", "opensource", r"(?:www )?opensource org licenses? artistic license 2 0", "opensource org licenses artistic license 2 0"),
    ("afl-3.0", "opensource", r"(?:www )?opensource org licenses? afl 3 0(?: php)?", "opensource org licenses afl 3 0 php"),
    ("osl-3.0", "opensource", r"(?:www )?opensource org licenses? osl 3 0(?: php)?", "opensource org licenses osl 3 0 php"),
    ("zlib", "opensource", r"(?:www )?opensource org licenses? zlib(?: license)?", "opensource org licenses zlib license"),
    ("ms-pl", "opensource", r"(?:www )?opensource org licenses? ms pl", "opensource org licenses ms pl"),
    ("upl-1.0", "opensource", r"(?:www )?opensource org licenses? upl", "opensource org licenses upl"),
    ("gpl-family", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?", "www gnu org licenses gpl html"),
    ("gpl-2.0", "gnu", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?", "www gnu org licenses old licenses gpl 2 0 html"),
    ("gpl-3.0", "gnu", r"(?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?", "www gnu org licenses gpl 3 0 en html"),
    ("lgpl-family", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: html| txt)?", "gnu org licenses lgpl html"),
    ("lgpl-2.1", "gnu", r"(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?", "gnu org licenses old licenses lgpl 2 1 html"),
    ("lgpl-3.0", "gnu", r"(?:www )?gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?", "gnu org licenses lgpl 3 0 html"),
    ("agpl-3.0", "gnu", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?", "gnu org licenses agpl 3 0 html"),
    ("gfdl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?", "gnu org copyleft fdl html"),
    ("gnu-licenses", "gnu", r"(?:www )?gnu org licenses", "www gnu org licenses"),
    ("gpl-family", "fsf|franklin|temple", r"(?:free software foundation inc|fsf)(?: \d+)? (?:59 temple place|51 franklin st(?:reet)?)", "free software foundation inc 51 franklin street"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0", None),
    ("mpl-1.1", "mozilla", r"(?:www )?mozilla org mpl (?:mpl )?1 1(?: html| txt)?", "www mozilla org mpl mpl 1 1 html"),
    ("mpl-family", "mozilla", r"(?:www )?mozilla org mpl", "www mozilla org mpl"),
    ("epl-1.0", "eclipse", r"(?:www )?eclipse org (?:legal|org documents) epl v ?10(?: html)?", "www eclipse org legal epl v10 html"),
    ("epl-2.0", "eclipse", r"(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?", "www eclipse org legal epl v20 html"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by (?:[1-4] [05])", "creativecommons org licenses by 4 0"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa (?:[1-4] [05])", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc (?:[1-4] [05])", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd (?:[1-4] [05])", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa (?:[1-4] [05])", "creativecommons org licenses by nc sa 2 5"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd (?:[1-4] [05])", "creativecommons org licenses by nc nd 3 0"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons org publicdomain zero 1 0"),
    ("public-domain-mark", "creativecommons", r"creativecommons org publicdomain mark(?: 1 0)?", "creativecommons org publicdomain mark 1 0"),
    ("creative-commons", "creativecommons", r"creativecommons org licenses", None),
    ("boost-1.0", "boost", r"(?:www )?boost org license 1 0 txt", "www boost org license 1 0 txt"),
    ("ofl-1.1", "sil", r"scripts sil org ofl", None),
    ("unlicense", "unlicense", r"unlicense org", None),
    ("wtfpl", "wtfpl", r"(?:www )?wtfpl net", "www wtfpl net"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?", "opendatacommons org licenses odbl 1 0"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?", "opendatacommons org licenses by 1 0"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?", "opendatacommons org licenses pddl 1 0"),
    ("ogl-uk", "nationalarchives", r"nationalarchives gov uk doc open government licence(?: version [123])?", "nationalarchives gov uk doc open government licence version 3"),
    ("busl", "mariadb", r"mariadb com bsl11", None),
    ("elastic", "elastic", r"elastic co licensing elastic license", None),
    ("sspl-1.0", "mongodb", r"mongodb com licensing server side public license", None),
    ("mulan-psl", "mulanpsl2", r"license coscl org cn mulanpsl2", None),
    ("cecill", "cecill", r"(?:www )?cecill info", "www cecill info"),
    ("artistic-family", "perlfoundation", r"(?:www )?perlfoundation org artistic license", "www perlfoundation org artistic license"),
)

#: Titles of licences with their versions.
VERSIONED = (
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version)? v?2 0(?: licen[cs]e)?", "apache license version 2 0"),
    ("apache-2.0", "apache|apache2", r"apache2 licen[cs]e|apache 2 licen[cs]e", "apache 2 license"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? v?1 1", "apache software license 1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: version)? v?1 0", "apache license 1 0"),
    ("gpl-1.0", "gnu", r"gnu general public licen[cs]e(?: version)? v?1(?: 0)?", "gnu general public license version 1"),
    ("gpl-2.0", "gnu", r"gnu general public licen[cs]e(?: version)? v?2(?: 0)?", "gnu general public license v2"),
    ("gpl-3.0", "gnu", r"gnu general public licen[cs]e(?: version)? v?3(?: 0)?", "gnu general public license version 3"),
    ("gpl-2.0-or-later", "gnu", r"gnu general public licen[cs]e(?: version)? v?2(?: 0)? or (?:any )?later(?: version)?", "gnu general public license version 2 or any later version"),
    ("gpl-3.0-or-later", "gnu", r"gnu general public licen[cs]e(?: version)? v?3(?: 0)? or (?:any )?later(?: version)?", "gnu general public license version 3 or later"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:version )?v?2(?: 0)?(?: only)?", "gpl 2 0 only"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:version )?v?3(?: 0)?(?: only)?", "gpl v3"),
    ("gpl-2.0-or-later", "gpl", r"(?:gnu )?gpl (?:version )?v?2(?: 0)? or (?:any )?later(?: version)?", "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "gpl", r"(?:gnu )?gpl (?:version )?v?3(?: 0)? or (?:any )?later(?: version)?", "gpl 3 0 or later"),
    ("gpl-2.0", "gplv2|gpl2", r"gplv2|gpl2", "gplv2"),
    ("gpl-3.0", "gplv3|gpl3", r"gplv3|gpl3", "gplv3"),
    ("lgpl-2.0", "gnu", r"gnu library general public licen[cs]e(?: version)? v?2(?: 0)?", "gnu library general public license version 2"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public licen[cs]e(?: version)? v?2 1", "gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public licen[cs]e(?: version)? v?3(?: 0)?", "gnu lesser general public license v3 0"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version )?v?2 1(?: only| or later)?", "lgpl 2 1 or later"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl (?:version )?v?3(?: 0)?(?: only| or later)?", "lgpl v3"),
    ("lgpl-2.1", "lgplv2|lgpl2", r"lgplv2(?: 1)?|lgpl2(?: 1)?", "lgplv2 1"),
    ("lgpl-3.0", "lgplv3|lgpl3", r"lgplv3|lgpl3", "lgplv3"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: version)? v?3(?: 0)?", "gnu affero general public license version 3"),
    ("agpl-3.0", "agpl|agplv3", r"(?:gnu )?agpl (?:version )?v?3(?: 0)?(?: only| or later)?|agplv3", "agpl 3 0"),
    ("gfdl-1.2", "documentation", r"gnu free documentation licen[cs]e(?: version)? v?1 2", "gnu free documentation license version 1 2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation licen[cs]e(?: version)? v?1 3", "gnu free documentation license version 1 3"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e(?: version)? v?1 0", "mozilla public license 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version)? v?1 1", "mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version)? v?2(?: 0)?", "mozilla public license 2 0"),
    ("mpl-2.0", "mpl", r"mpl (?:version )?v?2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mpl", r"mpl (?:version )?v?1 1", "mpl 1 1"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: version)?(?: v)? ?v?1 0", "eclipse public license v1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: version)?(?: v)? ?v?2 0", "eclipse public license version 2 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: version)?(?: v)? ?v?1 0", "eclipse distribution license v 1 0"),
    ("cddl-1.0", "license|licence", r"common development and distribution licen[cs]e(?: cddl)?(?: version)? v?1 0", "common development and distribution license cddl version 1 0"),
    ("cddl-1.1", "cddl", r"cddl(?: version)? v?1 1", "cddl 1 1"),
    ("cddl-1.0", "cddl", r"cddl(?: version)? v?1 0", "cddl 1 0"),
    ("cpl-1.0", "license|licence", r"common public licen[cs]e(?: version)? v?1 0", "common public license version 1 0"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: version)? v?1 0", "ibm public license version 1 0"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: version)? v?1 0", "artistic license 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? v?2(?: 0)?", "artistic license 2 0"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: version)? v?1 0", "boost software license 1 0"),
    ("bsl-1.0", "bsl", r"bsl 1 0", None),
    ("bsd-1-clause", "clause", r"bsd 1 clause|1 clause bsd", "bsd 1 clause"),
    ("bsd-2-clause", "clause", r"bsd 2 clause|2 clause bsd|two clause bsd", "2 clause bsd"),
    ("bsd-3-clause", "clause", r"bsd 3 clause|3 clause bsd|three clause bsd", "bsd 3 clause"),
    ("bsd-4-clause", "clause", r"bsd 4 clause|4 clause bsd|four clause bsd", "four clause bsd"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: zpl)?(?: version)? v?2 1", "zope public license zpl version 2 1"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: version)? v?3 0", "academic free license 3 0"),
    ("osl-3.0", "license|licence", r"open software licen[cs]e(?: version)? v?3 0", "open software license 3 0"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: version)? v?2 0", "educational community license 2 0"),
    ("eupl-1.1", "eupl|european", r"(?:european union public licen[cs]e|eupl)(?: version)? v?1 1", "eupl 1 1"),
    ("eupl-1.2", "eupl|european", r"(?:european union public licen[cs]e|eupl)(?: version)? v?1 2", "european union public licence 1 2"),
    ("cc-by-4.0", "creative", r"creative commons attribution 4 0(?: international)?", "creative commons attribution 4 0 international"),
    ("cc-by-3.0", "creative", r"creative commons attribution 3 0(?: unported)?", "creative commons attribution 3 0 unported"),
    ("cc-by-sa-4.0", "creative", r"creative commons attribution share ?alike 4 0(?: international)?", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa-3.0", "creative", r"creative commons attribution share ?alike 3 0(?: unported)?", "creative commons attribution share alike 3 0 unported"),
    ("cc-by-nc-4.0", "creative", r"creative commons attribution non ?commercial 4 0(?: international)?", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nc-sa-4.0", "creative", r"creative commons attribution non ?commercial share ?alike 4 0(?: international)?", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-nd-4.0", "creative", r"creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc-by-4.0", "cc", r"cc by 4 0", None),
    ("cc-by-3.0", "cc", r"cc by 3 0", None),
    ("cc-by-2.0", "cc", r"cc by 2 [05]", "cc by 2 5"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0", None),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0", None),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0", None),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4 0", None),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4 0", None),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4 0", None),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0 universal"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: version)? v?1 1", "sil open font license version 1 1"),
    ("odbl-1.0", "database", r"open database licen[cs]e(?: odbl)?(?: version)? v?1 0", "open database license odbl v1 0"),
    ("busl-1.1", "license|licence", r"business source licen[cs]e(?: version)? v?1 1", "business source license 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)? v?2(?: 0)?", "elastic license 2 0"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: upl)?(?: version)? v?1 0", "universal permissive license upl version 1 0"),
    ("wtfpl-2", "wtfpl", r"wtfpl(?: version)? v?2", "wtfpl version 2"),
    ("lppl", "latex", r"latex project public licen[cs]e(?: lppl)?(?: version)?(?: v?1 [0-3][abc]?)?", "latex project public license version 1 3c"),
)

#: Titles without a version, and short names.
TITLES = (
    ("mit", "license|licence", r"(?:the )?mit(?: expat| x11)? licen[cs]e", "the mit license"),
    ("mit", "expat", r"expat licen[cs]e", "expat license"),
    ("bsd", "license|licence", r"(?:new |modified |simplified |revised |original )?bsd(?: style)? licen[cs]e", "new bsd license"),
    ("isc", "license|licence", r"(?:the )?isc licen[cs]e", "the isc license"),
    ("apache-family", "apache", r"apache(?: software)? licen[cs]e", "apache software license"),
    ("gpl-family", "gnu", r"gnu general public licen[cs]e", "gnu general public license"),
    ("gpl-family", "gpl", r"gnu gpl|gpl licen[cs]e", "gnu gpl"),
    ("lgpl-family", "gnu", r"gnu (?:lesser|library) general public licen[cs]e", "gnu lesser general public license"),
    ("lgpl-family", "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e)?", "gnu lgpl"),
    ("agpl-family", "affero", r"(?:gnu )?affero general public licen[cs]e", "affero general public license"),
    ("agpl-family", "agpl", r"(?:gnu )?agpl(?: licen[cs]e)?", "agpl license"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e", "gnu free documentation license"),
    ("mpl-family", "mozilla", r"mozilla public licen[cs]e", "mozilla public license"),
    ("epl-family", "eclipse", r"eclipse public licen[cs]e", "eclipse public license"),
    ("cddl-family", "license|licence", r"common development and distribution licen[cs]e", "common development and distribution license"),
    ("cpl", "license|licence", r"common public licen[cs]e", "common public license"),
    ("artistic-family", "artistic", r"artistic licen[cs]e", "artistic license"),
    ("boost", "boost", r"boost(?: software)? licen[cs]e", "boost software license"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib libpng license"),
    ("psf", "python", r"python software foundation licen[cs]e", "python software foundation license"),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e", "ruby s license"),
    ("php", "php", r"php licen[cs]e(?: version)?(?: 3 0[01]?)?", "php license version 3 01"),
    ("vim", "vim", r"vim licen[cs]e", "vim license"),
    ("zpl", "zope", r"zope public licen[cs]e", "zope public license"),
    ("qpl", "license|licence", r"q public licen[cs]e", "q public license"),
    ("ncsa", "ncsa", r"ncsa(?: open source)? licen[cs]e", "ncsa open source license"),
    ("afl", "academic", r"academic free licen[cs]e", "academic free license"),
    ("osl", "license|licence", r"open software licen[cs]e", "open software license"),
    ("ecl", "educational", r"educational community licen[cs]e", "educational community license"),
    ("eupl", "european", r"european union public licen[cs]e", "european union public licence"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal license"),
    ("cc-by-family", "creative", r"creative commons attribution(?: licen[cs]e)?", "creative commons attribution license"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", "creative commons attribution non commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:atives|s)", "creative commons attribution noderivs"),
    ("cc-by-sa", "cc", r"cc by sa", None),
    ("cc-by-nc", "cc", r"cc by nc", None),
    ("cc-by-nd", "cc", r"cc by nd", None),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", None),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", None),
    ("creative-commons", "creative", r"creative commons(?: licen[cs]e)?", "creative commons license"),
    ("cc0", "creative", r"creative commons zero", None),
    ("unlicense", "unlicense", r"the unlicense", None),
    ("wtfpl", "wtfpl", r"wtfpl", None),
    ("wtfpl", "want", r"do what the f\w* you want to public licen[cs]e", "do what the foo you want to public license"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", "open font license"),
    ("odbl", "database", r"open database licen[cs]e", "open database license"),
    ("odc-by", "commons", r"open data commons attribution(?: licen[cs]e)?", "open data commons attribution license"),
    ("pddl", "dedication", r"public domain dedication and licen[cs]e", "public domain dedication and license"),
    ("busl", "license|licence", r"business source licen[cs]e", "business source license"),
    ("sspl", "license|licence", r"server side public licen[cs]e", "server side public license"),
    ("elastic", "elastic", r"elastic licen[cs]e", "elastic license"),
    ("commons-clause", "clause", r"commons clause(?: licen[cs]e condition)?", "commons clause license condition"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql license"),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", "openssl license"),
    ("upl", "universal", r"universal permissive licen[cs]e", "universal permissive license"),
    ("beerware", "beer", r"the beer ware licen[cs]e", "the beer ware license"),
    ("sleepycat", "sleepycat", r"sleepycat(?: public)? licen[cs]e", "sleepycat public license"),
    ("hpnd", "historical", r"historical permission notice and disclaimer", None),
    ("ogl-uk", "government", r"open government licen[cs]e", "open government licence"),
    ("rail", "responsible", r"responsible ai licen[cs]e", "responsible ai license"),
    ("llama-community", "llama", r"llama (?:\d )?(?:\d )?community licen[cs]e", "llama 2 community license"),
    ("gemma", "gemma", r"gemma terms of use", None),
)

#: Exceptions that widen a licence.
EXCEPTIONS = (
    ("exception-classpath", "classpath", r"(?:with )?(?:the )?classpath exception", "with the classpath exception"),
    ("exception-gcc", "gcc", r"gcc runtime library exception", None),
    ("exception-linking", "linking|permission", r"(?:as a special exception .{0,120}? )?permission to link this (?:library|program|code) with independent modules|(?:static |dynamic )?linking exception", "static linking exception"),
    ("exception-openssl", "openssl", r"(?:permission to link .{0,80}? with the openssl library|openssl(?: linking)? exception)", "openssl linking exception"),
    ("exception-llvm", "llvm", r"(?:with )?llvm exceptions?", "with llvm exception"),
    ("exception-autoconf", "autoconf", r"autoconf(?: configure script)? exception", "autoconf exception"),
    ("exception-bison", "bison", r"bison(?: parser skeleton)? exception", "bison exception"),
    ("exception-font", "font", r"(?:gpl )?font (?:embedding )?exception", "gpl font exception"),
    ("exception-swift", "swift", r"runtime library exception to the apache 2 0 license swift|swift exception", "swift exception"),
    ("exception-universal-foss", "foss", r"universal foss exception", None),
    ("gpl-or-later", "option", r"(?:either version \d(?: of the license)? )?or at your option any later version", "or at your option any later version"),
)

#: Notices that name no licence: priority, weight, rules.
NOTICES = (
    ("public-domain", "reserved", r"no rights reserved", None),
    ("some-rights", "reserved", r"some rights reserved", None),
    ("public-domain", "domain", r"(?:dedicated to|released (?:in)?to|placed in(?:to)?|donated to|belongs to|is in) the public domain", "placed in the public domain"),
    ("public-domain", "domain", r"this work has been identified as being free of known restrictions under copyright law including all related and neighboring rights public domain", None),
    ("public-domain", "government", r"this (?:software|work) is (?:a )?work of the (?:united states|u s) government", "this software is a work of the united states government"),
    ("warranty-disclaimer", "warranty|warranties", r"this software is provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)", "this software is provided as is without express or implied warranties"),
    ("warranty-disclaimer", "warranty", r"the software is provided as is without warranty of any kind(?: express or implied)?", "the software is provided as is without warranty of any kind express or implied"),
    ("warranty-disclaimer", "warranties", r"any express or implied warranties including but not limited to the implied warranties of merchantability", None),
    ("warranty-disclaimer", "liable", r"in no event shall the (?:authors?|copyright (?:holders?|owners?)|regents)(?: or (?:authors?|copyright holders?|contributors))? be liable", "in no event shall the authors or copyright holders be liable"),
    ("proprietary", "proprietary", r"proprietary and confidential", None),
    ("proprietary", "confidential", r"confidential and proprietary(?: information)?", "confidential and proprietary information"),
    ("proprietary", "proprietary", r"this (?:software|document|file|source code) is (?:the )?proprietary(?: information)?", "this document is proprietary information"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: or (?:copying|use|reproduction|distribution))?(?: of this (?:file|document|software|material))?(?: via any medium)? is (?:strictly )?prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", r"may not be reproduced(?: or (?:distributed|transmitted))? (?:in any form )?without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)", "may not be reproduced or transmitted in any form without prior written permission"),
    ("proprietary", "rewritten", r"this material may not be published broadcast rewritten or redistributed", None),
    ("proprietary", "permission", r"(?:used|reprinted|reproduced) (?:here )?(?:with|by) (?:kind )?permission(?: of)?", "reprinted with permission of"),
    ("proprietary", "trade", r"trade secrets? of", "trade secret of"),
    ("proprietary", "unpublished", r"this is (?:an )?unpublished (?:proprietary )?(?:source code|work)(?: of)?", "this is unpublished proprietary source code of"),
    ("eula", "agreement", r"end user licen[cs]e agreement", "end user license agreement"),
    ("eula", "agreement", r"by (?:installing|downloading|using|clicking) .{1,80}? you (?:agree|accept) .{0,60}?(?:this|the) (?:licen[cs]e )?agreement", "by installing the software you agree to be bound by this license agreement"),
    ("evaluation", "evaluation", r"for evaluation (?:purposes )?only", "for evaluation purposes only"),
    ("non-commercial", "commercial|noncommercial", r"for (?:personal and )?non ?commercial (?:use|purposes) only", "for personal and non commercial use only"),
    ("non-commercial", "commercial", r"not for commercial (?:use|purposes|distribution)", "not for commercial use"),
    ("non-commercial", "commercial", r"commercial (?:use|distribution) is (?:strictly )?(?:prohibited|forbidden|not permitted)", "commercial use is strictly prohibited"),
    ("academic-use", "academic|educational", r"for (?:academic|educational|research) and (?:research|educational|academic) (?:use|purposes) only academic|for (?:academic|educational) (?:use|purposes) only", "for academic use only"),
    ("redistribution-denied", "redistribute", r"do not (?:copy or )?redistribute(?: without permission)?", "do not redistribute without permission"),
    ("redistribution-denied", "redistributed", r"may not be (?:copied or )?redistributed", "may not be redistributed"),
    ("freeware", "freeware", r"(?:this (?:program|software) is|distributed as) freeware", "this program is freeware"),
    ("shareware", "shareware", r"(?:this (?:program|software) is|distributed as) shareware", "distributed as shareware"),
    ("attribution", "acknowledgement|acknowledgment|credit", r"(?:provided|as long as) (?:proper |due |appropriate )?(?:credit|acknowledge?ment) is given(?: to the author)?", "provided proper credit is given to the author"),
    ("license-file", "license|licence", r"(?:see|read|refer to) (?:the )?(?:accompanying |included |attached )?(?:file )?(?:licen[cs]e|license txt|license md)(?: file)? (?:for|in) (?:the )?(?:licen[cs]e|details|terms|full|copyright|root|project)", "see the accompanying license file for details"),
    ("license-file", "copying", r"(?:see|read|refer to) (?:the )?(?:file )?copying(?: file)? (?:for|in) (?:the )?(?:licen[cs]e|details|terms|full|copyright)", "see the file copying for details"),
    ("patent", "patent|patents", r"(?:protected|covered) by (?:one or more )?(?:u s |us )?patents?", "protected by one or more patents"),
    ("trademark", "trademark|trademarks", r"(?:is|are) (?:a )?(?:registered )?trademarks? of", "is a registered trademark of"),
    ("dmca", "dmca", r"dmca(?: takedown)? notice", "dmca takedown notice"),
    ("open-source", "license|licence", r"open source licen[cs]e", "open source license"),
    ("permission-notice", "permission", r"without (?:specific |express )?prior written permission", "without specific prior written permission"),
    ("copyright", "copyright", r"copyright (?:c )?(?:1[89]|20)\d\d(?: (?:1[89]|20)\d\d)*(?: by)?", "copyright c 1999 2004 by"),
    ("copyright", "copyright", r"(?:1[89]|20)\d\d copyright", "2001 copyright"),
    ("copyright", "copyright", r"copyright (?:is )?(?:held|owned) by", "copyright is held by"),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|by)", "copyrighted material"),
    ("copyright", "copyright|copyrights", r"all copyrights? (?:and|belong|remain)", "all copyright belong"),
)

#: Identifiers after "SPDX-License-Identifier:"; the longest that stands there wins by containment.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "SSPL-1.0", "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)

#: Rules of each group with its priority and weight of evidence.
GROUPS = ((90, 0.95, GRANTS), (80, 0.9, HEADERS), (70, 0.9, ADDRESSES), (60, 0.8, VERSIONED), (50, 0.7, TITLES), (45, 0.4, EXCEPTIONS), (40, 0.5, NOTICES))
