"""Signature rules for license texts, over lower-cased words joined by single spaces.

A rule has a label, a priority (3 identifier, 2 grant, 1 name or phrase), a
root and a keyword that every match contains, a pattern and a score. Named
licenses and identifiers get their rules from the forms below; the order of the list decides
between equal rules.
"""

from __future__ import annotations

#: Fixed phrases and labels of the contract.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

V = r"(?: version| v)?"
_LATER = r" or (?:at your option )?(?:any )?later(?: versions?)?"
GNU_VERSIONS = (("gpl", 1, 0), ("gpl", 2, 0), ("gpl", 3, 0), ("lgpl", 2, 0), ("lgpl", 2, 1), ("lgpl", 3, 0), ("agpl", 1, 0), ("agpl", 3, 0))
#: Label, keyword, pattern of the name; each name holds "licen", "gpl", " cc ", " cc0 " or another root.
NAMES = (
    ("apache-1.1", "apache", rf"apache (?:software )?licen[cs]e{V} ?1 1"),
    ("apache-2.0", "apache", rf"apache (?:software )?licen[cs]e{V} ?(?:2 0|2)"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit", "mit", r"(?:the )?mit (?:x11 )?licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution licen[cs]e"),
    ("expat", "expat", r"expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd) licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e"),
    ("bsd-0-clause", "bsd", r"(?:bsd 0 clause|zero clause bsd) licen[cs]e"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public licen[cs]e{V} ?1(?: 0)?"),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public licen[cs]e{V} ?2(?: 0)?"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public licen[cs]e{V} ?3(?: 0)?"),
    *((f"{kind}-{n}.{m}+", "general public", rf"(?:gnu )?{name}general public licen[cs]e{V} ?{n}{'(?: 0)?' if m == 0 else f' {m}'}{_LATER}")
      for kind, name in (("gpl", ""), ("lgpl", "(?:library |lesser )"), ("agpl", "affero ")) for k, n, m in GNU_VERSIONS if k == kind),
    *((f"{kind}-{n}.{m}+", kind, rf"(?:gnu )?{kind}(?: v| version| )?{n}{'(?: 0)?' if m == 0 else f' {m}'}{_LATER}") for kind, n, m in GNU_VERSIONS),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: v| version)? ?2(?: 0)?(?: only)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: v| version)? ?3(?: 0)?(?: only)?"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("lgpl-2.0", "public licen", rf"(?:gnu )?(?:library|lesser) general public licen[cs]e{V} ?2(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{V} ?2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{V} ?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: v?[0-9](?: [0-9])?)?"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[cs]e{V} ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: v?[0-9](?: [0-9])?)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{V} ?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{V} ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{V} ?1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{V} ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common public", r"common public licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{V} ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e"),
    ("python", "python", r"python licen[cs]e"),
    ("php", "php", r"php licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: 3 0)?"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: 3 0)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: 1 1)?"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e"),
    ("pddl", "dedication", r"public domain dedication and licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the", r"do what the fuck you want to public licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: 2 0)?"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e"),
    ("busl-1.1", "business source", r"business source licen[cs]e"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e"),
    ("cc-by-nc-nd", " cc by nc nd", r"cc by nc nd(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", " cc by nc sa", r"cc by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc", " cc by nc", r"cc by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", " cc by nd", r"cc by nd(?: [0-9] [0-9])?"),
    ("cc-by-sa", " cc by sa", r"cc by sa(?: [0-9] [0-9])?"),
    ("cc-by", " cc by", r"cc by(?: [0-9] [0-9])?"),
    ("cc0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [0-9] [0-9])?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no deriv(?:ative)?s?(?: [0-9] [0-9])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no deriv(?:ative)?s?(?: [0-9] [0-9])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [0-9] [0-9])?(?: international| unported)?"),
    ("cc", "creative commons", r"creative commons licen[cs]e"),
)
#: Label, keyword, pattern of the identifiers that tags and "licensed under" name without the word license.
IDENTIFIERS = (
    ("apache-1.1", "apache 1", r"apache 1 1"),
    ("apache-2.0", "apache 2", r"apache 2(?: 0)?"),
    ("apache", "apache", r"apache"),
    ("mit-0", "mit 0", r"mit 0"),
    ("mit", "mit", r"mit"),
    ("expat", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
    ("bsd-2-clause", "bsd 2", r"bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause(?: clear| attribution)?"),
    ("bsd-4-clause", "bsd 4", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd"),
    *((f"{kind}-{n}.{m}{plus}", kind, rf"(?:gnu )?{kind} ?v?{n}{'(?: 0)?' if m == 0 else f' {m}'}{later}")
      for kind, n, m in GNU_VERSIONS for plus, later in (("+", _LATER), ("", "(?: only)?"))),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "gfdl", rf"(?:gnu )?gfdl(?: 1 [0-3])?(?: (?:no )?invariants)?(?: only|{_LATER})?"),
    ("mpl-1.1", "mpl 1", r"mpl 1 1"),
    ("mpl-2.0", "mpl 2", r"mpl 2(?: 0)?(?: no copyleft exception)?"),
    ("mpl", "mpl", r"mpl"),
    ("epl-1.0", "epl 1", r"epl 1(?: 0)?"),
    ("epl-2.0", "epl 2", r"epl 2(?: 0)?"),
    ("epl", "epl", r"epl"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("cpl-1.0", "cpl 1", r"cpl 1 0"),
    ("eupl", "eupl", r"eupl(?: 1 [0-2])?"),
    ("artistic-2.0", "artistic 2", r"artistic 2(?: 0)?"),
    ("artistic", "artistic 1", r"artistic 1 0(?: perl| cl8)?"),
    ("zlib", "zlib", r"zlib"),
    ("bsl-1.0", "bsl 1", r"bsl 1 0"),
    ("psf-2.0", "psf 2", r"psf 2(?: 0)?"),
    ("python", "python 2", r"python 2 0(?: 1)?"),
    ("php", "php 3", r"php 3 0?[01]"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ms-rl", "ms rl", r"ms rl"),
    ("osl-3.0", "osl 3", r"osl 3 0"),
    ("afl-3.0", "afl 3", r"afl 3 0"),
    ("ofl-1.1", "ofl 1", r"(?:sil )?ofl 1 1(?: (?:no )?rfn)?"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("pddl", "pddl", r"pddl(?: 1 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("vim", "vim", r"vim"),
    ("postgresql", "postgresql", r"postgresql"),
    ("elastic-2.0", "elastic 2", r"elastic 2 0"),
    ("sspl-1.0", "sspl", r"sspl(?: 1 0)?"),
    ("busl-1.1", "busl", r"busl(?: 1 1)?"),
    ("cecill", "cecill", r"cecill(?: (?:1 [01]|2 [01]|b|c))?"),
    *((f"cc-{'-'.join(kind.split())}", f"cc {kind}", rf"cc {kind}(?: [0-9] [0-9])?") for kind in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
)
#: Identifiers that are products too: "available under x11" names no license.
PRODUCTS = ("apache", "x11", "ruby", "openssl", "vim", "postgresql")
#: Set before each operator of a tag's expression; stands in no text of words.
JOINER = "\x02"
#: An operand of a tag's expression: an identifier (longer ones are tried first) or a reference of one's own, perhaps with an
#: exception (whose names have at most seven words).
_OPERAND = (
    rf"(?:{'|'.join(sorted((i[2] for i in IDENTIFIERS), key=len, reverse=True))}|licenseref(?: (?!or |and |with )[a-z0-9]+){{1,8}})"
    r"(?: with(?: (?!or |and |with )[a-z0-9]+){1,8}?)?"
)
#: An operand after "identifier" or after the last match, and its operator: all of an expression, of whatever length, in one pass.
EXPRESSION = rf"(?:(?<= licen[cs]e identifier )|(?<!^)\G((?:or|and) ))({_OPERAND}) (?=(?:or(?! (?:later|any later|at your option))|and) )"
#: Priority, score, root, prefix, and what comes before the keyword.
IDENTIFIER_FORMS = (
    (3, 1.0, "spdx", r"spdx licen[cs]e identifier ", "identifier "),
    (3, 1.0, JOINER, rf"(?:(?<={JOINER}or )|(?<={JOINER}and ))", ""),
    (2, 0.95, "licen", r"(?:is |are )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the |a )?", ""),
    (2, 0.9, "ed under", r"(?:released|distributed|published) under (?:the )?(?:terms of )?(?:the |a )?", ""),
    (2, 0.9, "available under", r"available under (?:the )?(?:terms of )?(?:the |a )?", ""),
)
#: Priority, score, root, prefix and suffix of the forms in which a name may stand.
FORMS = (
    (3, 1.0, "spdx", r"spdx licen[cs]e identifier ", ""),
    (2, 0.95, "licen", r"(?:is |are )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the |a )?", ""),
    (2, 0.9, "", r"(?:released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |a )?", ""),
    (1, 0.7, "", "", ""),
)
#: Label, priority, score, root, keyword, pattern of rules that name no license.
PHRASES = (
    ("copyright", 1, 0.4, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", 1, 0.3, "copyright", "copyright", r"copyright (?:c )?by"),
    ("reserved", 1, 0.5, " reserved", "rights reserved", r"(?:all|some|no) rights reserved"),
    ("public-domain", 1, 0.6, "public domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", 1, 0.4, "public domain", "public domain", r"public domain"),
    ("mit", 2, 0.9, "permission", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 2, 0.9, "permission", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 2, 0.9, "redistribution", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("gpl", 2, 0.8, "free software", "free software", r"this program is free software you can redistribute it and or modify it"),
    ("no-warranty", 1, 0.3, "warrant", "without warrant", r"without warrant(?:y|ies) of any kind"),
    ("as-is", 1, 0.3, "as is", "provided as is", r"(?:software|work) is provided as is"),
    ("proprietary", 1, 0.6, "licen", "proprietary", r"proprietary licen[cs]e"),
    ("proprietary", 1, 0.5, "confidential", "confidential", r"proprietary and confidential"),
    ("commercial", 1, 0.5, "licen", "commercial", r"commercial licen[cs]e"),
    ("eula", 1, 0.6, "licen", "end user", r"end user licen[cs]e agreement"),
    ("unknown-license", 1, 0.3, "licen", "licen", r"licen[cs]ed under(?: the)?"),
    ("unknown-license", 1, 0.3, "licen", "licen", r"terms of (?:the|this) licen[cs]e"),
    ("unknown-license", 1, 0.2, "licen", "licen", r"see (?:the )?licen[cs]e(?: file)? for details"),
)

#: Label, priority, score, root, keyword, pattern of sentences in which license texts and notices say what they are.
SENTENCES = (
    ("apache-2.0", 2, 0.9, "licen", "apache org licen", r"(?:https? )?(?:www )?apache org licen[cs]es licen[cs]e 2 0"),
    ("apache-2.0", 2, 0.9, "licen", "the apache", r"you may not use this file except in compliance with the apache licen[cs]e"),
    ("apache-2.0", 1, 0.7, "licen", "in compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", 1, 0.7, "licen", "of this licen", r"subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you"),
    ("apache-2.0", 1, 0.6, "licen", "as is basis", r"software distributed under the licen[cs]e is distributed on an as is basis"),
    ("mit", 2, 0.9, "permission", "this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 1, 0.8, "licen", "without limitation the rights", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell"),
    ("mit", 1, 0.7, "licen", "opensource org licen", r"(?:https? )?(?:www )?opensource org licen[cs]es? mit(?: licen[cs]e)?(?: php)?"),
    ("x11", 1, 0.7, "x consortium", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 1, 0.8, "permission", "fee is hereby granted", r"for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", 2, 0.8, "permission", "documentation for any purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd-0-clause", 1, 0.8, "granted", "fee is hereby granted", r"for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", 1, 0.7, "copyright", "must retain the above", r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", 1, 0.7, "copyright", "must reproduce the above", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", 2, 0.9, "neither the name", "neither the name", r"neither the names? of (?:[a-z0-9]+ ){1,8}nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 2, 0.9, "software", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", 1, 0.7, "freebsd", "freebsd project", r"(?:official policies either expressed or implied of|copyright (?:c )?the) (?:the )?freebsd project"),
    ("gpl", 2, 0.9, "licen", "published by the free", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl-2.0", 2, 0.95, "software", "version 2", r"as published by the free software foundation (?:either )?version 2(?: of the licen[cs]e)?(?! 1)(?! or)"),
    ("gpl-2.0+", 2, 0.95, "licen", "any later version", r"as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0+", 2, 0.95, "licen", "any later version", r"as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl-2.1+", 2, 0.95, "licen", "any later version", r"as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version"),
    ("lgpl", 2, 0.9, "licen", "lesser general", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation"),
    ("agpl", 2, 0.9, "licen", "affero general", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("gpl", 1, 0.7, "licen", "copy of the gnu general", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", 1, 0.7, "licen", "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl", 1, 0.7, "licen", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", 1, 0.6, "gnu org", "gnu org", r"(?:https? )?(?:www )?gnu org (?:copyleft|licen[cs]es)(?: gpl(?: [0-9] [0-9])?)?(?: html)?"),
    ("gpl", 1, 0.6, "licen", "preamble the", r"preamble the licen[cs]es for most software are designed to take away your freedom"),
    ("gpl-classpath", 2, 0.9, "classpath", "classpath", r"(?:gnu )?classpath exception"),
    ("gpl-classpath", 2, 0.9, "permission", "special exception", r"as a special exception the copyright holders of this library give you permission to link"),
    ("gpl-autoconf", 2, 0.8, "licen", "special exception", r"as a special exception to the gnu general public licen[cs]e if you distribute this file as part of a program"),
    ("gfdl", 2, 0.9, "licen", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", 1, 0.6, "invariant sections", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 2, 0.95, "licen", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", 2, 0.9, "licen", "contents of this file are subject", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl", 1, 0.7, "mozilla org", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl(?: 2 0)?"),
    ("npl-1.1", 2, 0.9, "licen", "netscape public", r"netscape public licen[cs]e(?: version)?(?: 1 1)?"),
    ("epl-1.0", 2, 0.9, "eclipse", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", 2, 0.9, "eclipse", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("edl-1.0", 2, 0.9, "licen", "eclipse distribution", r"eclipse distribution licen[cs]e(?: v)?(?: 1 0)?"),
    ("cddl-1.0", 2, 0.9, "licen", "common development", r"subject to the terms of the common development and distribution licen[cs]e"),
    ("artistic", 2, 0.8, "perl itself", "perl itself", r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("zlib", 2, 0.9, "software", "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 1, 0.7, "software", "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", 2, 0.9, "licen", "boost org licen", r"(?:https? )?(?:www )?boost org licen[cs]e 1 0 txt"),
    ("bsl-1.0", 1, 0.8, "permission", "organization obtaining a copy", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", 2, 0.9, "software", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 2, 0.9, "you just do", "what the fuck", r"you just do what the fuck you want to"),
    ("psf-2.0", 1, 0.7, "licen", "psf is making python", r"psf is making python available to licen[cs]ee on an as is basis"),
    ("openssl", 1, 0.8, "software", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 2, 0.8, "software", "eric young", r"this product includes cryptographic software written by eric young"),
    ("libpng", 2, 0.8, "licen", "png", r"(?:png reference library|libpng) licen[cs]e(?: version 2)?"),
    ("ijg", 2, 0.8, "software", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("curl", 2, 0.8, "licen", "curl licen", r"(?:the )?curl licen[cs]e"),
    ("ncsa", 2, 0.9, "licen", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("unicode", 2, 0.8, "licen", "unicode", r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?"),
    ("w3c", 2, 0.9, "software", "w3c", r"w3c software (?:notice and licen[cs]e|and document licen[cs]e)"),
    ("json", 2, 0.8, "software", "used for good", r"the software shall be used for good not evil"),
    ("beerware", 2, 0.8, "buy me a beer", "buy me a beer", r"you can buy me a beer in return"),
    ("upl-1.0", 2, 0.9, "licen", "universal permissive", r"(?:the )?universal permissive licen[cs]e(?: v)?(?: 1 0)?"),
    ("blueoak-1.0.0", 2, 0.9, "licen", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("mulan-psl-2.0", 2, 0.9, "mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)?"),
    ("polyform", 2, 0.8, "licen", "polyform", r"polyform (?:noncommercial|shield|strict|small business|perimeter) licen[cs]e(?: 1 0 0)?"),
    ("commons-clause", 2, 0.9, "commons clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?(?: v1 0)?"),
    ("prosperity", 2, 0.8, "licen", "prosperity", r"prosperity public licen[cs]e(?: 3 0 0)?"),
    ("parity", 2, 0.8, "licen", "parity public", r"parity public licen[cs]e(?: 7 0 0)?"),
    ("apsl-2.0", 2, 0.9, "licen", "apple public", r"apple public source licen[cs]e(?: version)?(?: 2 0)?"),
    ("ipl-1.0", 2, 0.9, "licen", "ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("qpl-1.0", 2, 0.8, "licen", "q public", r"(?:the )?q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("sleepycat", 2, 0.8, "licen", "sleepycat", r"sleepycat licen[cs]e"),
    ("ofl-1.1", 1, 0.7, "reserved font", "reserved font", r"with reserved font names?"),
    ("cc-by-sa", 2, 0.9, "licen", "creativecommons org", r"creativecommons org licen[cs]es by sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", 2, 0.9, "licen", "creativecommons org", r"creativecommons org licen[cs]es by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", 2, 0.9, "licen", "creativecommons org", r"creativecommons org licen[cs]es by nc nd(?: [0-9] [0-9])?"),
    ("cc-by-nc", 2, 0.9, "licen", "creativecommons org", r"creativecommons org licen[cs]es by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", 2, 0.9, "licen", "creativecommons org", r"creativecommons org licen[cs]es by nd(?: [0-9] [0-9])?"),
    ("cc-by", 2, 0.9, "licen", "creativecommons org", r"creativecommons org licen[cs]es by(?: [0-9] [0-9])?"),
    ("cc0", 2, 0.9, "public", "publicdomain zero", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc-pdm", 2, 0.9, "public", "publicdomain mark", r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("odc-by", 2, 0.9, "licen", "open data commons", r"open data commons attribution licen[cs]e(?: v)?(?: 1 0)?"),
    ("ogl-uk", 2, 0.9, "licen", "open government", r"open government licen[cs]e(?: v)?(?: ?[123])?(?: 0)?"),
    ("etalab", 2, 0.9, "etalab", "etalab", r"licen[cs]e ouverte etalab|etalab (?:open )?licen[cs]e|licen[cs]e etalab"),
    ("openrail", 2, 0.9, "openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?"),
    ("crown-copyright", 1, 0.6, "copyright", "crown copyright", r"crown copyright(?: c)?(?: (?:19|20)[0-9]{2})?"),
    ("public-domain", 1, 0.6, "government", "work of the", r"work of the (?:u s|us|united states) government (?:and )?(?:is )?(?:not subject to copyright protection|(?:is )?in the public domain)"),
    ("no-warranty", 1, 0.4, "warrant", "implied warrant", r"without (?:any|even the) (?:express or )?implied warrant(?:y|ies)(?: of merchantability)?"),
    ("no-warranty", 1, 0.4, "merchantab", "fitness for a particular", r"(?:warrant(?:y|ies) of )?merchantability (?:and|or) fitness for a particular purpose"),
    ("proprietary", 2, 0.8, "proprietary", "proprietary information", r"(?:contains|constitutes) (?:confidential (?:and|or) )?proprietary information of"),
    ("proprietary", 1, 0.6, "reproduc", "may not be reproduced", r"may not be reproduced (?:in whole or in part |or distributed )?without (?:prior )?(?:written )?permission"),
    ("proprietary", 1, 0.6, "unauthori", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or distribution)? (?:of this (?:file|software|work) )?is (?:strictly )?prohibited"),
    ("non-commercial", 1, 0.6, "commercial", "commercial", r"(?:for|free for) (?:personal and )?non ?commercial use(?: only)?"),
    ("research-only", 1, 0.6, "research", "research purposes only", r"(?:for|to) (?:academic |non commercial )?(?:and )?research purposes only"),
    ("evaluation", 1, 0.5, "licen", "evaluation", r"evaluation licen[cs]e(?: agreement)?"),
    ("multiple", 1, 0.5, "licen", "dual", r"dual licen[cs]ed(?: under)?"),
    ("multiple", 1, 0.5, "licen", "under either of", r"licen[cs]ed under either of(?: (?:[a-z0-9]+ ){1,12}at your option)?"),
    ("unknown-license", 1, 0.3, "licen", "third party", r"third party licen[cs]es?"),
    ("unknown-license", 1, 0.3, "licen", "bsd style", r"governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
)


def _root(keyword: str, pattern: str) -> str:
    if "licen[cs]e" in pattern or "unlicense" in pattern:
        return "licen"
    return next(r for r in ("gpl", " cc ", " cc0 ", "creative commons") if r in pattern or r.strip() + " " in pattern + " " or r.strip() in keyword)


def rules() -> list[dict]:
    """All rules in order, the contract's phrases first."""
    out = [dict(label=label, priority=1, score=0.7, base=True, root={"cc by": " cc "}.get(phrase, phrase.rsplit(" ")[-1][:5]), keyword=f" {phrase} ", pattern=phrase) for phrase, label in BASE_PHRASES]
    for priority, score, root, before, lead in IDENTIFIER_FORMS:
        for label, keyword, name in IDENTIFIERS:
            if priority == 2 and root != "licen" and label in PRODUCTS:
                continue
            # a GNU name may begin with gnu
            key = " " + (lead if not name.startswith("(?:") else "") + keyword
            out.append(dict(label=label, priority=priority, score=score, base=False, root=root, keyword=key, pattern=before + name))
    for priority, score, root, before, after in FORMS:
        for label, keyword, name in NAMES:
            out.append(dict(label=label, priority=priority, score=score, base=False, root=root or _root(keyword, name), keyword=keyword, pattern=before + name + after))
    for label, priority, score, root, keyword, pattern in PHRASES + SENTENCES:
        out.append(dict(label=label, priority=priority, score=score, base=False, root=root, keyword=keyword, pattern=pattern))
    return [r | {"rule": i, "pattern": rf"(?<= )(?:{r['pattern']})(?= )"} for i, r in enumerate(out)]
