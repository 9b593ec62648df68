"""Signatures of licenses written by hand: wording of headers, grants, conditions, disclaimers and addresses.

Each is (label, priority, score, words) and is matched by licenses.signature: blanks
stand for what separates words. Priority 0 are identifiers, 1 wording that only one
license has, 2 wording that a family shares, 3 mere mentions.
"""

from __future__ import annotations

#: Wording of published licenses.
TEXTS: tuple[tuple[str, int, float, bytes], ...] = (
    # MIT and its relatives
    ("mit", 1, 0.98, b"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, 0.90, b"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, 0.85, b"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", 2, 0.80, b"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, 0.70, b"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 1, 0.95, b"opensource org licenses mit(?: license)?"),
    ("mit", 3, 0.75, b"(?:mit|expat) licen[cs]ed?"),
    ("mit", 3, 0.75, b"under (?:the )?mit"),
    ("mit-0", 1, 0.95, b"mit no attribution"),
    ("x11", 1, 0.95, b"x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", 1, 0.95, b"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", 2, 0.85, b"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", 1, 0.95, b"opensource org licenses isc(?: license)?"),
    ("0bsd", 1, 0.95, b"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 1, 0.90, b"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    # BSD
    ("bsd", 2, 0.90, b"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 2, 0.85, b"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 2, 0.85, b"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 1, 0.95, b"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 1, 0.90, b"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, 0.95, b"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 2, 0.80, b"this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties"),
    ("bsd-2-clause", 1, 0.95, b"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", 1, 0.95, b"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 1, 0.90, b"(?:bsd 2 clause|2 clause bsd|two clause bsd|freebsd) license"),
    ("bsd-3-clause", 1, 0.90, b"(?:bsd 3 clause|3 clause bsd|three clause bsd) license"),
    ("bsd-4-clause", 1, 0.90, b"(?:bsd 4 clause|4 clause bsd|four clause bsd) license"),
    ("bsd", 3, 0.70, b"bsd style license"),
    # Apache
    ("apache-2.0", 1, 0.98, b"licensed under the apache license version 2 0"),
    ("apache-2.0", 1, 0.95, b"www apache org licenses license 2 0"),
    ("apache-2.0", 1, 0.95, b"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", 2, 0.85, b"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 2, 0.85, b"without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"),
    ("apache-2.0", 1, 0.90, b"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", 1, 0.90, b"apache 2(?: 0)? licensed?"),
    ("apache-2.0", 1, 0.90, b"opensource org licenses apache 2 0"),
    ("apache-2.0", 1, 0.95, b"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"),
    ("apache-1.1", 1, 0.95, b"this product includes software developed by the apache (?:software foundation|group)"),
    ("apache-1.1", 1, 0.90, b"the names apache server and apache group must not be used to endorse or promote products derived from this software"),
    # GNU
    ("gpl", 2, 0.90, b"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", 1, 0.95, b"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", 1, 0.95, b"gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0-only", 1, 0.95, b"gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0-only", 1, 0.95, b"gnu general public license version 3 as published by the free software foundation"),
    ("gpl", 2, 0.85, b"you should have received a copy of the gnu general public license along with"),
    ("gpl", 2, 0.80, b"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl-2.0", 1, 0.95, b"gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", 1, 0.95, b"gnu org licenses gpl 3 0"),
    ("gpl", 2, 0.90, b"(?:www )?gnu org licenses gpl"),
    ("gpl", 2, 0.90, b"gnu org copyleft gpl"),
    ("gpl-2.0", 2, 0.85, b"gpl ?v ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", 2, 0.85, b"gpl ?v ?3(?: 0)?(?: only| or later)?"),
    ("gpl", 3, 0.75, b"(?:gnu )?gpl"),
    ("lgpl", 2, 0.90, b"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 1, 0.95, b"gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", 1, 0.95, b"gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2.0", 1, 0.95, b"gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl", 2, 0.85, b"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", 2, 0.90, b"(?:www )?gnu org licenses lgpl"),
    ("lgpl", 3, 0.75, b"(?:gnu )?lgpl(?: ?v ?[23](?: [01])?)?"),
    ("agpl-3.0", 1, 0.95, b"gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", 2, 0.85, b"you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", 1, 0.90, b"(?:www )?gnu org licenses agpl"),
    ("agpl-3.0", 3, 0.80, b"(?:gnu )?agpl(?: ?v ?3)?"),
    ("gfdl-1.3", 1, 0.95, b"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.3", 2, 0.85, b"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl-1.3", 1, 0.90, b"(?:www )?gnu org licenses fdl"),
    ("gpl-linking-exception", 1, 0.90, b"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("classpath-exception", 1, 0.95, b"gpl 2 0 with classpath exception"),
    # Mozilla, Eclipse, Sun and other weak copyleft
    ("mpl-2.0", 1, 0.98, b"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 1, 0.95, b"mozilla org mpl 2 0"),
    ("mpl-2.0", 2, 0.85, b"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 1, 0.95, b"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", 1, 0.95, b"the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", 1, 0.95, b"the contents of this file are subject to the netscape public license"),
    ("epl-1.0", 1, 0.95, b"eclipse org legal epl v10"),
    ("epl-2.0", 1, 0.95, b"eclipse org legal epl(?: v)? ?2 0"),
    ("epl-2.0", 1, 0.95, b"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl-1.0", 1, 0.95, b"eclipse distribution license"),
    ("cddl-1.0", 1, 0.95, b"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", 1, 0.90, b"opensource org licenses cddl"),
    ("cpl-1.0", 1, 0.95, b"the accompanying program is provided under the terms of this common public license"),
    ("ms-pl", 1, 0.95, b"this license governs use of the accompanying software if you use the software you accept this license"),
    ("osl-3.0", 1, 0.90, b"licensed under the open software license version 3 0"),
    ("afl-3.0", 1, 0.90, b"licensed under the academic free license version 3 0"),
    ("eupl-1.2", 1, 0.95, b"licensed under the eupl"),
    ("eupl-1.2", 1, 0.95, b"joinup ec europa eu .{0,60}eupl"),
    ("cecill-2.1", 1, 0.90, b"governed by the cecill(?: [abc])? license"),
    ("artistic-2.0", 1, 0.95, b"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("artistic-1.0-perl", 1, 0.90, b"you can redistribute it and or modify it under the same terms as perl itself"),
    ("lppl-1.3c", 1, 0.95, b"may be distributed and or modified under the conditions of the latex project public license"),
    ("ofl-1.1", 1, 0.95, b"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 1, 0.95, b"scripts sil org ofl"),
    ("ofl-1.1", 2, 0.85, b"the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    # permissive ones of single projects
    ("zlib", 1, 0.95, b"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", 2, 0.85, b"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", 1, 0.90, b"the png reference library is supplied as is"),
    ("bsl-1.0", 1, 0.98, b"distributed under the boost software license version 1 0"),
    ("bsl-1.0", 1, 0.95, b"boost org license 1 0 txt"),
    ("unlicense", 1, 0.98, b"this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, 0.95, b"(?:please refer to )?(?:http |https )?unlicense org"),
    ("wtfpl", 1, 0.95, b"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("wtfpl", 3, 0.85, b"wtfpl"),
    ("beerware", 1, 0.95, b"as long as you retain this notice you can do whatever you want with this stuff if we meet some day"),
    ("psf-2.0", 1, 0.95, b"psf is making python available to licensee on an as is basis"),
    ("php-3.01", 1, 0.95, b"this product includes php software freely available from"),
    ("openssl", 1, 0.95, b"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 1, 0.95, b"this product includes cryptographic software written by eric young"),
    ("postgresql", 1, 0.90, b"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", 1, 0.95, b"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("icu", 1, 0.90, b"icu license icu 1 8 1 and later"),
    ("unicode", 1, 0.95, b"unicode (?:license|inc license agreement) data files and software"),
    ("curl", 1, 0.90, b"curl license|licensed under the curl"),
    ("json", 1, 0.95, b"the software shall be used for good not evil"),
    ("ftl", 1, 0.90, b"portions of this software are copyright .{1,40} the freetype project"),
    ("vim", 1, 0.90, b"vim is charityware|distributed under the vim license"),
    ("upl-1.0", 1, 0.90, b"the universal permissive license upl version 1 0"),
    ("mulanpsl-2.0", 1, 0.95, b"license coscl org cn mulanpsl ?2"),
    # public domain
    ("public-domain", 3, 0.80, b"(?:in|into|to) the public domain"),
    ("public-domain", 2, 0.85, b"(?:has been|is hereby|are hereby) (?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 2, 0.85, b"this work is a work of the united states government .{0,80}public domain"),
    ("cc0-1.0", 1, 0.95, b"creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", 1, 0.95, b"to the extent possible under law .{1,120} waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 1, 0.90, b"cc0(?: 1 0)?(?: universal)?(?: license| public domain dedication)?"),
    ("cc-pdm-1.0", 1, 0.95, b"creativecommons org publicdomain mark 1 0"),
    ("pddl-1.0", 1, 0.95, b"opendatacommons org licenses pddl"),
    # Creative Commons
    ("cc-by-4.0", 1, 0.95, b"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 1, 0.95, b"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", 1, 0.95, b"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 1, 0.95, b"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", 1, 0.95, b"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", 1, 0.95, b"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", 1, 0.95, b"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 1, 0.95, b"creativecommons org licenses by nc nd 4 0"),
    ("cc-by", 2, 0.85, b"creativecommons org licenses by"),
    ("cc-by-4.0", 1, 0.95, b"(?:this work is )?licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", 1, 0.95, b"creative commons attribution share ?alike 4 0 international"),
    ("cc-by-sa-3.0", 1, 0.95, b"creative commons attribution share ?alike 3 0 (?:unported|license)"),
    ("cc-by-nc-4.0", 1, 0.95, b"creative commons attribution non ?commercial 4 0 international"),
    ("cc-by-nc-sa-4.0", 1, 0.95, b"creative commons attribution non ?commercial share ?alike 4 0 international"),
    ("cc-by-nc-nd-4.0", 1, 0.95, b"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international"),
    ("cc-by-sa", 2, 0.88, b"cc by sa(?: [0-9] [0-9])?"),
    ("cc-by-nc", 2, 0.88, b"cc by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", 2, 0.88, b"cc by nd(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", 1, 0.90, b"cc by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", 1, 0.90, b"cc by nc nd(?: [0-9] [0-9])?"),
    ("cc-by-4.0", 3, 0.80, b"cc by 4 0"),
    ("cc-by-3.0", 3, 0.80, b"cc by 3 0"),
    ("cc-by-2.0", 3, 0.80, b"cc by 2 0"),
    ("odbl-1.0", 1, 0.95, b"opendatacommons org licenses odbl"),
    ("odc-by-1.0", 1, 0.95, b"opendatacommons org licenses by"),
    # source available, and all rights reserved
    ("busl-1.1", 1, 0.95, b"use of this software is governed by the business source license"),
    ("busl-1.1", 1, 0.95, b"mariadb com bsl11"),
    ("sspl-1.0", 1, 0.95, b"server side public license version 1"),
    ("elastic-2.0", 1, 0.95, b"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 1, 0.95, b"the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", 1, 0.90, b"polyform noncommercial license"),
    ("proprietary", 3, 0.70, b"all rights reserved"),
    ("proprietary", 2, 0.85, b"this (?:software|document|material) is (?:the )?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 2, 0.85, b"unauthori[sz]ed (?:copying|reproduction|distribution) .{0,60}is (?:strictly )?prohibited"),
    ("proprietary", 2, 0.85, b"may not be (?:reproduced|copied|distributed) .{0,60}without (?:the )?(?:prior )?(?:written|express) (?:permission|consent)"),
)
