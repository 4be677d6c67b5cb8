"""Signature rules for licenses, in order of priority: label, kind, keyword, pattern.

Patterns are matched on lower-case words with single spaces between them, on
whole words; "3.0" is ``3 0`` there and "CC-BY" is ``cc by``. A rule is tried
only where its keyword occurs. Gaps are bounded, so a match takes linear time.
"""

from __future__ import annotations

from typing import NamedTuple

BASE, TEXT, NOTICE, TAG, NAME, CLUE = range(6)  # kinds, the strongest first
WEIGHTS = {BASE: 1.0, TEXT: 0.95, NOTICE: 0.9, TAG: 0.8, NAME: 0.6, CLUE: 0.3}

BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


class Rule(NamedTuple):
    label: str
    kind: int
    keyword: str
    pattern: str


UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|offered)(?: \S+){0,3}? (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)?"
LATER = r"(?:or (?:\S+ ){0,3}?later|or (?:\S+ ){0,3}?newer|or any later version)"

HAND_WRITTEN = (
    # sentences of license texts
    ("mit", TEXT, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", TEXT, "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", TEXT, "without limitation the rights", r"deal in the software without restriction including without limitation the rights(?: \S+){0,20} and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", TEXT, "distribute this software for any purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", TEXT, "distribute this software for any purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", TEXT, "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", TEXT, "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", TEXT, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", TEXT, "endorse or promote", r"(?:neither the name|the names?) of(?: \S+){1,20} (?:may not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", TEXT, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", TEXT, "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", TEXT, "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", TEXT, "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", TEXT, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", TEXT, "gnu general public", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", TEXT, "gnu general public", r"you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
    ("gpl-2.0", TEXT, "either version 2", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", TEXT, "either version 3", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", TEXT, "take away your freedom", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("lgpl", TEXT, "gnu lesser general", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", TEXT, "gnu library general", r"redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", TEXT, "gnu lesser general", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl", TEXT, "gnu affero general", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", TEXT, "gnu affero general", r"you should have received a copy of the gnu affero general public license"),
    ("mpl-2.0", TEXT, "mozilla public", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("mpl-1.1", TEXT, "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", TEXT, "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", TEXT, "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
    ("cddl-1.0", TEXT, "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("unlicense", TEXT, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", TEXT, "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", TEXT, "what the fuck", r"do what the fuck you want to(?: public license)?"),
    ("zlib", TEXT, "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", TEXT, "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", TEXT, "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("cc0-1.0", TEXT, "affirmer hereby overtly", r"overcoming the fullest extent permitted by(?: but not in contravention of)? applicable law affirmer hereby overtly"),
    ("cc0-1.0", TEXT, "waived all copyright", r"waived all copyright and related or neighbo?u?ring rights"),
    ("cc0-1.0", TEXT, "dedicated the work to the public domain", r"has dedicated the work to the public domain"),
    ("cc-by", TEXT, "share copy and redistribute", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", TEXT, "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", TEXT, "same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", TEXT, "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", TEXT, "distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl-1.1", TEXT, "reserved font name", r"no modified version of the font software may use the reserved font names?"),
    ("ofl-1.1", TEXT, "font software", r"this font software is licensed under the sil open font license"),
    ("artistic-2.0", TEXT, "standard version", r"you are always permitted to make arbitrary other copies of(?: \S+){0,6} standard version"),
    ("python-2.0", TEXT, "python software foundation", r"this license agreement is between the python software foundation"),
    ("php-3.01", TEXT, "php", r"this product includes php software freely available from"),
    ("openssl", TEXT, "openssl", r"this product includes software developed by the openssl project"),
    ("x11", TEXT, "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("curl", TEXT, "above copyright notice and this permission notice appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("beerware", TEXT, "me a beer", r"you can buy me a beer in return"),
    ("elastic-2.0", TEXT, "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", TEXT, "change date", r"effective on the change date(?: \S+){0,20} change license"),
    ("sspl-1.0", TEXT, "functionality of the program", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("commons-clause", TEXT, "commons clause", r"commons clause licen[sc]e condition(?: v?1 0)?"),
    ("json", TEXT, "good not evil", r"the software shall be used for good not evil"),
    ("ncsa", TEXT, "names of its contributors", r"neither the names of(?: \S+){1,12} nor the names of its contributors may be used"),
    # notices
    ("apache-2.0", NOTICE, "apache", UNDER + r" apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", NOTICE, "apache", UNDER + r" apache (?:software )?licen[sc]e(?: version| v)? ?1 1"),
    ("apache-1.0", NOTICE, "apache", UNDER + r" apache (?:software )?licen[sc]e(?: version| v)? ?1 0"),
    ("apache", NOTICE, "apache", UNDER + r" apache (?:software )?licen[sc]e"),
    ("mit", NOTICE, "mit licen", UNDER + r" mit licen[sc]e"),
    ("mit", NOTICE, "mit x11 licen", UNDER + r" mit x11 licen[sc]e"),
    ("mit", NOTICE, "expat licen", UNDER + r" expat licen[sc]e"),
    ("mit", NOTICE, "mit licen", r"this (?:project|software|work|library|code|file|package) (?:is )?(?:uses )?(?:the )?mit licen[sc]ed?"),
    ("mit-0", NOTICE, "no attribution", UNDER + r" mit no attribution(?: licen[sc]e)?"),
    ("x11", NOTICE, "x11", UNDER + r" x11 licen[sc]e"),
    ("isc", NOTICE, "isc licen", UNDER + r" isc licen[sc]e"),
    ("bsd-2-clause", NOTICE, "bsd", UNDER + r" (?:simplified|freebsd|2 clause|two clause) bsd(?: style)? licen[sc]e"),
    ("bsd-2-clause", NOTICE, "bsd", UNDER + r" bsd 2 clause(?: simplified)? licen[sc]e"),
    ("bsd-3-clause", NOTICE, "bsd", UNDER + r" (?:new|modified|revised|3 clause|three clause) bsd(?: style)? licen[sc]e"),
    ("bsd-3-clause", NOTICE, "bsd", UNDER + r" bsd 3 clause(?: new or revised| new)? licen[sc]e"),
    ("bsd-4-clause", NOTICE, "bsd", UNDER + r" (?:original|4 clause|four clause) bsd(?: style)? licen[sc]e"),
    ("bsd", NOTICE, "bsd", UNDER + r" (?:a )?bsd(?: style)? licen[sc]e"),
    ("agpl-3.0", NOTICE, "affero", UNDER + r" gnu affero general public licen[sc]e(?: agpl)?(?: version| v)? ?3(?: 0)?"),
    ("agpl", NOTICE, "affero", UNDER + r" (?:gnu )?affero general public licen[sc]e"),
    ("lgpl-2.1", NOTICE, "lesser", UNDER + r" gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? ?2 1"),
    ("lgpl-3.0", NOTICE, "lesser", UNDER + r" gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl", NOTICE, "lesser", UNDER + r" (?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", NOTICE, "library", UNDER + r" gnu library general public licen[sc]e"),
    ("gpl-2.0-or-later", NOTICE, "general public", UNDER + r" gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?2(?: 0)? " + LATER),
    ("gpl-3.0-or-later", NOTICE, "general public", UNDER + r" gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?3(?: 0)? " + LATER),
    ("gpl-2.0", NOTICE, "general public", UNDER + r" gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", NOTICE, "general public", UNDER + r" gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?3(?: 0)?"),
    ("gpl", NOTICE, "general public", UNDER + r" (?:gnu )?general public licen[sc]e"),
    ("gpl-2.0", NOTICE, "gpl", UNDER + r" (?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3.0", NOTICE, "gpl", UNDER + r" (?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", NOTICE, "gpl", UNDER + r" (?:gnu )?gpl"),
    ("lgpl-2.1", NOTICE, "lgpl", UNDER + r" (?:gnu )?lgpl(?: version)? ?v?2 1"),
    ("lgpl-3.0", NOTICE, "lgpl", UNDER + r" (?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl", NOTICE, "lgpl", UNDER + r" (?:gnu )?lgpl"),
    ("agpl-3.0", NOTICE, "agpl", UNDER + r" (?:gnu )?agpl(?: version)? ?v?3(?: 0)?"),
    ("agpl", NOTICE, "agpl", UNDER + r" (?:gnu )?agpl"),
    ("gfdl", NOTICE, "free documentation", UNDER + r" gnu free documentation licen[sc]e(?: version| v)?(?: ?1 [123])?"),
    ("gfdl", NOTICE, "free documentation", r"copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2.0", NOTICE, "mozilla", UNDER + r" mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", NOTICE, "mozilla", UNDER + r" mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?1 1"),
    ("mpl", NOTICE, "mozilla", UNDER + r" mozilla public licen[sc]e"),
    ("mpl-2.0", NOTICE, " mpl", UNDER + r" mpl(?: version| v)? ?2(?: 0)?"),
    ("epl-2.0", NOTICE, "eclipse", UNDER + r" eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", NOTICE, "eclipse", UNDER + r" eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?"),
    ("epl", NOTICE, "eclipse", UNDER + r" eclipse public licen[sc]e"),
    ("eupl-1.2", NOTICE, "european union", UNDER + r" european union public licen[sc]e(?: version| v)? ?1 2"),
    ("eupl", NOTICE, "european union", UNDER + r" european union public licen[sc]e"),
    ("cddl-1.0", NOTICE, "cddl", UNDER + r" cddl(?: version| v)?(?: ?1 [01])?"),
    ("cecill-2.1", NOTICE, "cecill", UNDER + r" cecill(?: free software)? licen[sc]e(?: agreement)?(?: version| v)?(?: ?2 [01])?"),
    ("cecill", NOTICE, "cecill", r"(?:sous|par) (?:la )?licence cecill(?: [bc])?"),
    ("bsl-1.0", NOTICE, "boost", UNDER + r" boost software licen[sc]e(?: version| v)?(?: ?1 0)?"),
    ("zlib", NOTICE, "zlib", UNDER + r" zlib(?: libpng)? licen[sc]e"),
    ("artistic-2.0", NOTICE, "artistic", UNDER + r" artistic licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("artistic-1.0", NOTICE, "artistic", UNDER + r" (?:perl )?artistic licen[sc]e"),
    ("perl-5", NOTICE, "perl", r"(?:redistribute it and or modify it )?under the same terms as perl(?: itself)?"),
    ("python-2.0", NOTICE, "python software foundation", UNDER + r" python software foundation licen[sc]e(?: version 2)?"),
    ("php-3.01", NOTICE, "php", UNDER + r" php licen[sc]e(?: version)?(?: ?3 0?1)?"),
    ("ruby", NOTICE, "ruby", UNDER + r" (?:same (?:license|terms) as )?ruby(?: s)?(?: licen[sc]e)?"),
    ("ofl-1.1", NOTICE, "open font", UNDER + r" sil open font licen[sc]e(?: version| v)?(?: ?1 [01])?"),
    ("unlicense", NOTICE, "unlicense", UNDER + r" unlicense"),
    ("wtfpl", NOTICE, "wtfpl", UNDER + r" wtfpl(?: version| v)?(?: ?2(?: 0)?)?"),
    ("ms-pl", NOTICE, "microsoft public", UNDER + r" microsoft public licen[sc]e"),
    ("ms-rl", NOTICE, "microsoft reciprocal", UNDER + r" microsoft reciprocal licen[sc]e"),
    ("elastic-2.0", NOTICE, "elastic", UNDER + r" elastic licen[sc]e(?: version| v)?(?: ?2 0)?"),
    ("busl-1.1", NOTICE, "business source", UNDER + r" business source licen[sc]e(?: version| v)?(?: ?1 1)?"),
    ("sspl-1.0", NOTICE, "server side public", UNDER + r" server side public licen[sc]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("odbl-1.0", NOTICE, "open database", UNDER + r" open database licen[sc]e(?: odbl)?(?: v?1 0)?"),
    ("odc-by-1.0", NOTICE, "open data commons attribution", UNDER + r" open data commons attribution licen[sc]e(?: v?1 0)?"),
    ("pddl-1.0", NOTICE, "public domain dedication", UNDER + r" (?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl-uk-3.0", NOTICE, "open government", r"(?:contains public sector information )?licensed under the open government licen[sc]e(?: version| v)?(?: ?3 0)?"),
    ("etalab-2.0", NOTICE, "licence ouverte", r"licence ouverte(?: open licence)?(?: etalab)?(?: version| v)?(?: ?[12] 0)?"),
    ("dl-de-by-2.0", NOTICE, "datenlizenz", r"datenlizenz deutschland namensnennung(?: version)?(?: ?2 0)?"),
    ("openrail", NOTICE, "openrail", UNDER + r" (?:creativeml |bigscience |bigcode )?openrail(?: [a-z])?(?: \+\+)?(?: licen[sc]e)?"),
    ("llama", NOTICE, "licen", UNDER + r" llama(?: \d)*(?: community)? licen[sc]e(?: agreement)?"),
    ("cc-by-nc-nd-4.0", NOTICE, "attribution noncommercial noderiv", r"creative commons attribution noncommercial noderiv(?:ative|atives|s)? 4 0(?: international)?"),
    ("cc-by-nc-sa-4.0", NOTICE, "attribution noncommercial sharealike", r"creative commons attribution noncommercial sharealike 4 0(?: international)?"),
    ("cc-by-nc-nd-3.0", NOTICE, "attribution noncommercial noderiv", r"creative commons attribution noncommercial noderiv(?:ative|atives|s)? 3 0(?: unported)?"),
    ("cc-by-nc-sa-3.0", NOTICE, "attribution noncommercial sharealike", r"creative commons attribution noncommercial sharealike 3 0(?: unported)?"),
    ("cc-by-nc-4.0", NOTICE, "attribution non", r"creative commons attribution non ?commercial 4 0(?: international)?"),
    ("cc-by-nc-3.0", NOTICE, "attribution non", r"creative commons attribution non ?commercial 3 0(?: unported)?"),
    ("cc-by-nd-4.0", NOTICE, "attribution no", r"creative commons attribution no ?deriv(?:ative|atives|s)? 4 0(?: international)?"),
    ("cc-by-nd-3.0", NOTICE, "attribution no", r"creative commons attribution no ?deriv(?:ative|atives|s)? 3 0(?: unported)?"),
    ("cc-by-sa-4.0", NOTICE, "attribution share", r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-sa-3.0", NOTICE, "attribution share", r"creative commons attribution share ?alike 3 0(?: unported)?"),
    ("cc-by-sa-2.5", NOTICE, "attribution share", r"creative commons attribution share ?alike 2 5(?: generic)?"),
    ("cc-by-sa-2.0", NOTICE, "attribution share", r"creative commons attribution share ?alike 2 0(?: generic)?"),
    ("cc-by-4.0", NOTICE, "creative commons attribution", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-3.0", NOTICE, "creative commons attribution", r"creative commons attribution 3 0(?: unported)?"),
    ("cc-by-2.5", NOTICE, "creative commons attribution", r"creative commons attribution 2 5(?: generic)?"),
    ("cc-by-2.0", NOTICE, "creative commons attribution", r"creative commons attribution 2 0(?: generic)?"),
    ("cc-by-nc-nd", NOTICE, "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", NOTICE, "creative commons", r"creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?"),
    ("cc-by-nc", NOTICE, "creative commons", r"creative commons attribution non ?commercial(?: licen[sc]e)?"),
    ("cc-by-nd", NOTICE, "creative commons", r"creative commons attribution no ?deriv(?:ative|atives|s)?(?: licen[sc]e)?"),
    ("cc-by-sa", NOTICE, "creative commons", r"creative commons attribution share ?alike(?: licen[sc]e)?"),
    ("cc-by", NOTICE, "creative commons", r"creative commons attribution licen[sc]e"),
    ("cc0-1.0", NOTICE, "creative commons", r"creative commons (?:zero|cc0|0)(?: v?1 0)?(?: universal)?"),
    ("cc", NOTICE, "creative commons", r"(?:under a|licence|lizenz|licencia) creative commons(?: licen[sc]e| lizenz)?"),
    ("public-domain", NOTICE, "public domain", r"(?:released|placed|dedicated|put|is|are) (?:\S+ )?(?:in|into|to) the public domain"),
    ("public-domain", NOTICE, "domaine public", r"(?:est|sont|verse dans|versé dans) (?:dans )?(?:le )?domaine public"),
    ("public-domain", NOTICE, "gemeinfrei", r"(?:ist|sind) gemeinfrei"),
    ("public-domain", NOTICE, "dominio público", r"(?:es|son|está en) (?:de |el )?dominio público"),
    # identifiers and addresses
    ("mit", TAG, "spdx", r"spdx licen[sc]e identifier mit"),
    ("apache-2.0", TAG, "spdx", r"spdx licen[sc]e identifier apache 2 0"),
    ("gpl-2.0-only", TAG, "spdx", r"spdx licen[sc]e identifier gpl 2 0 only"),
    ("gpl-2.0-or-later", TAG, "spdx", r"spdx licen[sc]e identifier gpl 2 0 or later"),
    ("gpl-2.0", TAG, "spdx", r"spdx licen[sc]e identifier gpl 2 0"),
    ("gpl-3.0-only", TAG, "spdx", r"spdx licen[sc]e identifier gpl 3 0 only"),
    ("gpl-3.0-or-later", TAG, "spdx", r"spdx licen[sc]e identifier gpl 3 0 or later"),
    ("gpl-3.0", TAG, "spdx", r"spdx licen[sc]e identifier gpl 3 0"),
    ("lgpl-2.1", TAG, "spdx", r"spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", TAG, "spdx", r"spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", TAG, "spdx", r"spdx licen[sc]e identifier agpl 3 0(?: only| or later)?"),
    ("bsd-2-clause", TAG, "spdx", r"spdx licen[sc]e identifier bsd 2 clause"),
    ("bsd-3-clause", TAG, "spdx", r"spdx licen[sc]e identifier bsd 3 clause"),
    ("mpl-2.0", TAG, "spdx", r"spdx licen[sc]e identifier mpl 2 0"),
    ("isc", TAG, "spdx", r"spdx licen[sc]e identifier isc"),
    ("zlib", TAG, "spdx", r"spdx licen[sc]e identifier zlib"),
    ("cc0-1.0", TAG, "spdx", r"spdx licen[sc]e identifier cc0 1 0"),
    ("cc-by-4.0", TAG, "spdx", r"spdx licen[sc]e identifier cc by 4 0"),
    ("cc-by-sa-4.0", TAG, "spdx", r"spdx licen[sc]e identifier cc by sa 4 0"),
    ("unlicense", TAG, "spdx", r"spdx licen[sc]e identifier unlicense"),
    ("spdx-other", TAG, "spdx", r"spdx licen[sc]e identifier \S+"),
    ("apache-2.0", TAG, "apache org", r"apache org licenses license 2 0(?: html| txt)?"),
    ("mit", TAG, "opensource org", r"opensource org licenses mit(?: license)?"),
    ("bsd-3-clause", TAG, "opensource org", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", TAG, "opensource org", r"opensource org licenses bsd 2 clause"),
    ("gpl-3.0", TAG, "gnu org", r"gnu org licenses gpl 3 0(?: \S+)?"),
    ("gpl-2.0", TAG, "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0(?: \S+)?"),
    ("gpl", TAG, "gnu org", r"gnu org licenses(?: gpl(?: html| txt)?)?"),
    ("mpl-2.0", TAG, "mozilla org", r"mozilla org mpl 2 0"),
    ("cc-by-nc-nd", TAG, "creativecommons org", r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc-by-nc-sa", TAG, "creativecommons org", r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc", TAG, "creativecommons org", r"creativecommons org licenses by nc(?: \d \d)?"),
    ("cc-by-nd", TAG, "creativecommons org", r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-sa", TAG, "creativecommons org", r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by", TAG, "creativecommons org", r"creativecommons org licenses by(?: \d \d)?"),
    ("cc0-1.0", TAG, "creativecommons org", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", TAG, "creativecommons org", r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by-nc-nd-4.0", TAG, "cc by", r"cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", TAG, "cc by", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", TAG, "cc by", r"cc by nc nd 3 0"),
    ("cc-by-nc-sa-3.0", TAG, "cc by", r"cc by nc sa 3 0"),
    ("cc-by-nc-4.0", TAG, "cc by", r"cc by nc 4 0"),
    ("cc-by-nc-3.0", TAG, "cc by", r"cc by nc 3 0"),
    ("cc-by-nd-4.0", TAG, "cc by", r"cc by nd 4 0"),
    ("cc-by-sa-4.0", TAG, "cc by", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", TAG, "cc by", r"cc by sa 3 0"),
    ("cc-by-4.0", TAG, "cc by", r"cc by 4 0"),
    ("cc-by-3.0", TAG, "cc by", r"cc by 3 0"),
    ("cc-by-nc-nd", TAG, "cc by", r"cc by nc nd"),
    ("cc-by-nc-sa", TAG, "cc by", r"cc by nc sa"),
    ("cc-by-nd", TAG, "cc by", r"cc by nd"),
    ("cc-by-sa", TAG, "cc by", r"cc by sa"),
    ("cc-by", TAG, "cc by", UNDER + r" cc by(?! (?:nc|nd|sa))"),
    ("cc0-1.0", TAG, "cc0", r"cc0(?: 1 0)?"),
    # names
    ("apache-2.0", NAME, "apache", r"apache (?:2 0|licen[sc]e 2(?: 0)?)"),
    ("apache", NAME, "apache", r"apache licen[sc]e"),
    ("mit", NAME, "mit licen", r"(?:the )?mit licen[sc]e"),
    ("bsd", NAME, "bsd", r"bsd(?: \d clause)? licen[sc]e"),
    ("isc", NAME, "isc licen", r"isc licen[sc]e"),
    ("agpl", NAME, "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("lgpl", NAME, "lesser general", r"(?:gnu )?lesser general public licen[sc]e"),
    ("gpl", NAME, "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl", NAME, "lgpl", r"lgpl ?v?\d?(?: \d)?"),
    ("agpl", NAME, "agpl", r"agpl ?v?\d?(?: \d)?"),
    ("gpl", NAME, "gpl", r"(?:gnu )?gpl ?v?\d?(?: \d)?"),
    ("mpl", NAME, "mozilla public", r"mozilla public licen[sc]e"),
    ("epl", NAME, "eclipse public", r"eclipse public licen[sc]e"),
    ("eupl", NAME, "eupl", r"eupl(?: v?\d \d)?"),
    ("bsl-1.0", NAME, "boost software", r"boost software licen[sc]e"),
    ("ofl-1.1", NAME, "open font", r"(?:sil )?open font licen[sc]e"),
    ("gfdl", NAME, "gfdl", r"gfdl(?: \d \d)?"),
    ("artistic", NAME, "artistic", r"artistic licen[sc]e"),
    ("unlicense", NAME, "unlicense", r"the unlicense"),
    ("cc", NAME, "creative commons", r"creative commons"),
    # clues
    ("proprietary", CLUE, "proprietary", r"(?:proprietary and confidential|confidential and proprietary|proprietary licen[sc]e)"),
    ("proprietary", CLUE, "end user", r"end user licen[sc]e agreement"),
    ("proprietary", CLUE, "all rights reserved", r"all rights reserved"),
    ("proprietary", CLUE, "rechte vorbehalten", r"alle rechte vorbehalten"),
    ("proprietary", CLUE, "droits réservés", r"tous droits réservés"),
    ("proprietary", CLUE, "derechos reservados", r"todos los derechos reservados"),
    ("commercial", CLUE, "commercial licen", r"commercial licen[sc]e"),
    ("free", CLUE, "open source", r"open source licen[sc]e"),
    ("free", CLUE, "free software", r"free software licen[sc]e"),
    ("noncommercial", CLUE, "commercial use only", r"(?:for )?non ?commercial use only"),
    ("unknown", CLUE, "licen", UNDER + r" (?:\S+ ){0,4}?licen[sc]e"),
)

RULES = [Rule(label, BASE, phrase, phrase) for label, phrase in BASE_PHRASES] + [Rule(*rule) for rule in HAND_WRITTEN]
