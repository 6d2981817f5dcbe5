"""License scan by ordered signature rules, with DataFrame functions alone.

A text becomes its words (lower case for A-Z, runs of ASCII letters and digits and
of all characters beyond ASCII), each between two spaces of its own, so that a rule
starts and ends at words without looking around, and rules in a row share nothing.

Rules are regexes over words. A rule is tried only where its keyword stands in the
text; the keywords are looked for once a text, so most texts meet no regex at all.
What rules find are intervals of words. They are gone through by start, longer ones
first, then by priority and by the order of the rules. An interval that lies within
the one held is suppressed; of two that overlap otherwise the one with the better
priority is held, the earlier one if equal; one beyond it ends the one held, which
is then kept. Rules without a label (negations, other senses) are kept for nothing
but to suppress. Labels are those of the kept intervals and those of the base
phrases, which nothing suppresses; the score is the best of their rules, 0 without.

Everything happens within the row: nothing is shuffled, so no source or copy can be
hot, and time and memory go with the words of a text and its matches. Null texts are
empty ones: no words, no labels, score 0. Repeated rows give repeated rows, an empty
table an empty one; other columns stay as they are, and names that clash with those
of the results get an underscore.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Score of a rule by its priority: tag, grant, notice, name, address, short form, remark.
SCORES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.6, 0.4)
TAG, GRANT, NOTICE, NAME, ADDRESS, SHORT, REMARK = range(7)
BASE_SCORE = 0.95

# Licences by label, keyword, identifier, name, and name in addresses ("" if none). A space parts words.
LICENSES = (
    ("mit", "mit", "mit", r"mit(?: x11| expat)? licen[cs]e", r"licenses mit"),
    ("mit", "expat", "expat", r"expat licen[cs]e", r"licenses expat"),
    ("mit-0", "mit", "mit 0", r"mit no attribution(?: licen[cs]e)?", r"licenses mit 0"),
    ("x11", "x11", "x11", r"x11(?: style)? licen[cs]e", r"licenses x11"),
    ("isc", "isc", "isc", r"isc(?: style)? licen[cs]e", r"licenses isc"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"licenses zlib"),
    ("boost-1", "boost", "bsl 1 0", r"boost software licen[cs]e(?: version)?(?: v?1(?: 0)?)?", r"boost org license 1 0"),
    ("bsd-0", "bsd", "0bsd", r"(?:zero clause|0 clause|free public) bsd licen[cs]e", r"licenses 0bsd"),
    ("bsd-1", "bsd", "bsd 1 clause", r"(?:1|one) clause bsd licen[cs]e", r"licenses bsd 1 clause"),
    ("bsd-2", "bsd", "bsd 2 clause", r"(?:(?:2|two) clause|simplified|freebsd) bsd(?: style)? licen[cs]e", r"licenses bsd 2 clause"),
    ("bsd-3", "bsd", "bsd 3 clause", r"(?:(?:3|three) clause|new|modified|revised) bsd(?: style)? licen[cs]e", r"licenses bsd 3 clause"),
    ("bsd-4", "bsd", "bsd 4 clause", r"(?:(?:4|four) clause|original|old) bsd(?: style)? licen[cs]e", r"licenses bsd 4 clause"),
    ("bsd", "bsd", "bsd", r"bsd(?: style| type)? licen[cs]e", r"licenses bsd license"),
    ("apache-1", "apache", "apache 1 [01]", r"apache(?: software)? licen[cs]e(?: version)? v?1 [01]", r"licenses license 1 1"),
    ("apache-2", "apache", "apache 2 0", r"apache(?: software)? licen[cs]e(?: version)?(?: v?2(?: 0)?)?", r"apache org licenses license 2 0"),
    ("gpl-1", "gnu", "gpl 1 0", r"gnu general public licen[cs]e(?: version)? v?1(?: 0)?", r"licenses gpl 1 0"),
    ("gpl-2", "gnu", "gpl 2 0", r"gnu general public licen[cs]e(?: version)? v?2(?: 0)?(?: only)?", r"licenses (?:old licenses )?gpl 2 0"),
    ("gpl-2-or-later", "gnu", "gpl 2 0 or later", r"gnu general public licen[cs]e(?: version)? v?2(?: 0)? or (?:any )?later(?: version)?", r"licenses gpl 2 0 or later"),
    ("gpl-3", "gnu", "gpl 3 0", r"gnu general public licen[cs]e(?: version)? v?3(?: 0)?(?: only)?", r"licenses gpl 3 0"),
    ("gpl-3-or-later", "gnu", "gpl 3 0 or later", r"gnu general public licen[cs]e(?: version)? v?3(?: 0)? or (?:any )?later(?: version)?", r"licenses gpl 3 0 or later"),
    ("gpl", "general", "gpl", r"(?:gnu )?general public licen[cs]e", r"licenses gpl"),
    ("lgpl-2", "gnu", "lgpl 2 0", r"gnu library general public licen[cs]e(?: version)?(?: v?2(?: 0)?)?", r"licenses lgpl 2 0"),
    ("lgpl-2.1", "gnu", "lgpl 2 1", r"gnu lesser general public licen[cs]e(?: version)? v?2 1", r"licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "gnu", "lgpl 3 0", r"gnu lesser general public licen[cs]e(?: version)? v?3(?: 0)?", r"licenses lgpl 3 0"),
    ("lgpl", "lesser", "lgpl", r"(?:gnu )?lesser general public licen[cs]e", r"licenses lgpl"),
    ("agpl-3", "gnu", "agpl 3 0", r"gnu affero general public licen[cs]e(?: version)?(?: v?3(?: 0)?)?", r"licenses agpl 3 0"),
    ("gfdl-1.3", "gnu", "gfdl 1 3", r"gnu free documentation licen[cs]e(?: version)?(?: v?1 [123])?", r"licenses fdl 1 3"),
    ("mpl-1.1", "mozilla", "mpl 1 1", r"mozilla public licen[cs]e(?: version)? v?1 1", r"mozilla org mpl 1 1"),
    ("mpl-2", "mozilla", "mpl 2 0", r"mozilla public licen[cs]e(?: version)?(?: v?2(?: 0)?)?", r"mozilla org mpl 2 0"),
    ("epl-1", "eclipse", "epl 1 0", r"eclipse public licen[cs]e(?: version)? v?1(?: 0)?", r"legal epl v10"),
    ("epl-2", "eclipse", "epl 2 0", r"eclipse public licen[cs]e(?: version)?(?: v?2(?: 0)?)?", r"legal epl 2 0"),
    ("edl-1", "eclipse", "edl 1 0", r"eclipse distribution licen[cs]e(?: version)?(?: v?1(?: 0)?)?", r"documents edl v10"),
    ("cddl-1", "development", "cddl 1 0", r"common development and distribution licen[cs]e(?: version)?(?: v?1(?: 0)?)?", r"licenses cddl 1 0"),
    ("cpl-1", "common", "cpl 1 0", r"common public licen[cs]e(?: version)?(?: v?1(?: 0)?)?", r"licenses cpl 1 0"),
    ("eupl-1", "european", "eupl 1 [012]", r"european union public licen[cs]e(?: version)?(?: v?1 [012])?", r"software page eupl"),
    ("artistic-1", "artistic", "artistic 1 0", r"artistic licen[cs]e(?: version)? v?1(?: 0)?", r"licenses artistic license 1 0"),
    ("artistic-2", "artistic", "artistic 2 0", r"artistic licen[cs]e(?: version)? v?2(?: 0)?", r"licenses artistic license 2 0"),
    ("artistic", "artistic", "artistic", r"(?:perl )?artistic licen[cs]e", r"licenses artistic license"),
    ("osl-3", "open", "osl 3 0", r"open software licen[cs]e(?: version)?(?: v?3(?: 0)?)?", r"licenses osl 3 0"),
    ("afl-3", "academic", "afl 3 0", r"academic free licen[cs]e(?: version)?(?: v?3(?: 0)?)?", r"licenses afl 3 0"),
    ("ms-pl", "microsoft", "ms pl", r"microsoft public licen[cs]e", r"licenses ms pl"),
    ("ms-rl", "microsoft", "ms rl", r"microsoft reciprocal licen[cs]e", r"licenses ms rl"),
    ("ofl-1.1", "font", "ofl 1 1", r"(?:sil )?open font licen[cs]e(?: version)?(?: v?1 [01])?", r"sil org ofl"),
    ("psf-2", "python", "psf 2 0", r"python software foundation licen[cs]e(?: version)?(?: v?2)?", r"docs python org license"),
    ("ruby", "ruby", "ruby", r"ruby(?: s)? licen[cs]e", r"ruby lang org license"),
    ("php-3", "php", "php 3 0?1?", r"php licen[cs]e(?: version)?(?: v?3 0?1?)?", r"php net license"),
    ("unlicense", "unlicense", "unlicense", r"the unlicense", r"unlicense org"),
    ("wtfpl", "want", "wtfpl", r"do what the f\w* you want to public licen[cs]e", r"wtfpl net"),
    ("cc0-1", "cc0", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", r"publicdomain zero 1 0"),
    ("cc-by", "creative", "cc by [1234] 0", r"creative commons attribution(?: [1234] 0)?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", r"licenses by [1234] 0"),
    ("cc-by-sa", "creative", "cc by sa [1234] 0", r"creative commons attribution share ?alike(?: [1234] 0)?(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", r"licenses by sa [1234] 0"),
    ("cc-by-nd", "creative", "cc by nd [1234] 0", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] 0)?(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", r"licenses by nd [1234] 0"),
    ("cc-by-nc", "creative", "cc by nc [1234] 0", r"creative commons attribution non ?commercial(?: [1234] 0)?(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", r"licenses by nc [1234] 0"),
    ("cc-by-nc-sa", "creative", "cc by nc sa [1234] 0", r"creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", r"licenses by nc sa [1234] 0"),
    ("cc-by-nc-nd", "creative", "cc by nc nd [1234] 0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] 0)?(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", r"licenses by nc nd [1234] 0"),
    ("odbl-1", "database", "odbl 1 0", r"open (?:data commons open )?database licen[cs]e(?: v?1 0)?", r"opendatacommons org licenses odbl"),
    ("pddl-1", "dedication", "pddl 1 0", r"public domain dedication and licen[cs]e", r"opendatacommons org licenses pddl"),
    ("odc-by-1", "commons", "odc by 1 0", r"open data commons attribution licen[cs]e(?: v?1 0)?", r"opendatacommons org licenses by"),
    ("openrail", "openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: [ms]+)?(?: licen[cs]e)?", r"licenses openrail"),
    ("sspl-1", "server", "sspl 1 0", r"server side public licen[cs]e(?: version)?(?: v?1)?", r"licensing server side public license"),
    ("busl-1.1", "business", "busl 1 1", r"business source licen[cs]e(?: version)?(?: v?1 1)?", r"mariadb com bsl11"),
    ("elastic-2", "elastic", "elastic 2 0", r"elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?", r"co licensing elastic license"),
)

# Short forms, notices, remarks and senses that are none, by priority, label ("" suppresses only), keyword and pattern.
PHRASES = (
    (SHORT, "gpl-2", "gpl|gplv2|gplv3|gpl2|gpl3", r"gpl ?v?2(?: 0)?(?: only)?"), (SHORT, "gpl-2", "gplv2", r"gplv2(?: 0)?(?: only)?"),
    (SHORT, "gpl-3", "gpl|gplv2|gplv3|gpl2|gpl3", r"gpl ?v?3(?: 0)?(?: only)?"), (SHORT, "gpl-3", "gplv3", r"gplv3(?: 0)?(?: only)?"),
    (SHORT, "gpl-2-or-later", "gpl|gplv2|gplv3|gpl2|gpl3", r"gpl ?v?2(?: 0)? (?:or later|or any later version|plus)"), (SHORT, "gpl-2-or-later", "gplv2", r"gplv2 (?:or later|plus)"),
    (SHORT, "gpl-3-or-later", "gpl|gplv2|gplv3|gpl2|gpl3", r"gpl ?v?3(?: 0)? (?:or later|or any later version|plus)"), (SHORT, "gpl-3-or-later", "gplv3", r"gplv3 (?:or later|plus)"),
    (SHORT, "gpl", "gpl", r"(?:gnu )?gpl(?: licen[cs]e)?"), (SHORT, "lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e)?"),
    (SHORT, "lgpl-2.1", "lgpl", r"lgpl v?2 1"), (SHORT, "lgpl-2.1", "lgplv2", r"lgplv2 1"), (SHORT, "lgpl-3", "lgpl", r"lgpl v?3(?: 0)?"),
    (SHORT, "lgpl-3", "lgplv3", r"lgplv3"), (SHORT, "agpl-3", "agpl", r"(?:gnu )?agpl(?: v?3(?: 0)?)?(?: licen[cs]e)?"), (SHORT, "agpl-3", "agplv3", r"agplv3"),
    (SHORT, "mit", "mit", r"mit licen[cs]ed"), (SHORT, "mit", "mit", r"licen[cs]e mit"), (SHORT, "mit", "mit", r"licen[cs]ed (?:as|with) mit"),
    (SHORT, "apache-2", "apache", r"apache v?2(?: 0)?(?: licen[cs]e)?"), (SHORT, "apache-2", "apache", r"apache licen[cs]ed"), (SHORT, "apache-2", "asl", r"asl v?2(?: 0)?"),
    (SHORT, "bsd", "bsd", r"bsd licen[cs]ed"), (SHORT, "bsd-2", "bsd", r"bsd 2(?: clause)?"), (SHORT, "bsd-3", "bsd", r"bsd 3(?: clause)?"),
    (SHORT, "mpl-2", "mpl", r"mpl v?2(?: 0)?"), (SHORT, "mpl-1.1", "mpl", r"mpl v?1 1"), (SHORT, "epl-1", "epl", r"epl v?1(?: 0)?"), (SHORT, "epl-2", "epl", r"epl v?2(?: 0)?"),
    (SHORT, "cddl-1", "cddl", r"cddl(?: licen[cs]e)?(?: v?1(?: 0)?)?"), (SHORT, "eupl-1", "eupl", r"eupl(?: v?1 [012])?"), (SHORT, "wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?"),
    (SHORT, "cc-by", "cc", r"cc by(?: v?[1234] 0)?"), (SHORT, "cc-by-sa", "cc", r"cc by sa(?: v?[1234] 0)?"), (SHORT, "cc-by-nd", "cc", r"cc by nd(?: v?[1234] 0)?"),
    (SHORT, "cc-by-nc", "cc", r"cc by nc(?: v?[1234] 0)?"), (SHORT, "cc-by-nc-sa", "cc", r"cc by nc sa(?: v?[1234] 0)?"), (SHORT, "cc-by-nc-nd", "cc", r"cc by nc nd(?: v?[1234] 0)?"),
    (SHORT, "cc0-1", "cc", r"cc 0(?: 1 0)?"), (SHORT, "odbl-1", "odbl", r"odbl(?: v?1 0)?"), (SHORT, "sspl-1", "sspl", r"sspl(?: v?1)?"), (SHORT, "busl-1.1", "busl", r"busl(?: 1 1)?"),
    (SHORT, "ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?"), (SHORT, "psf-2", "psf", r"psf licen[cs]e"), (SHORT, "ms-pl", "ms", r"ms pl"),
    (NOTICE, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (NOTICE, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (NOTICE, "x11", "permission", r"permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    (NOTICE, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (NOTICE, "bsd-3", "endorse", r"neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse"),
    (NOTICE, "bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    (NOTICE, "zlib", "altered", r"altered source versions must be plainly marked as such"),
    (NOTICE, "boost-1", "boost", r"distributed under the boost software licen[cs]e"),
    (NOTICE, "gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    (NOTICE, "lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    (NOTICE, "agpl-3", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    (NOTICE, "gpl-2-or-later", "gnu", r"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    (NOTICE, "gpl-3-or-later", "gnu", r"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    (NOTICE, "lgpl-2.1", "gnu", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e"),
    (NOTICE, "lgpl-3", "gnu", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e"),
    (NOTICE, "mpl-2", "mozilla", r"subject to the terms of the mozilla public licen[cs]e v?2 0"),
    (NOTICE, "mpl-1.1", "mozilla", r"subject to the mozilla public licen[cs]e version 1 1"),
    (NOTICE, "apache-2", "apache", r"you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at https? www apache org licenses license 2 0"),
    (NOTICE, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (NOTICE, "epl-2", "eclipse", r"made available under the terms of the eclipse public licen[cs]e 2 0"),
    (NOTICE, "epl-1", "eclipse", r"made available under the terms of the eclipse public licen[cs]e v1 0"),
    (NOTICE, "ofl-1.1", "font", r"this font software is licensed under the sil open font licen[cs]e"),
    (NOTICE, "cc0-1", "waived", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    (NOTICE, "proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)(?: information)?"),
    (NOTICE, "proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|work|software|document)"),
    (NOTICE, "proprietary", "written", r"without (?:the )?(?:express |prior )+written (?:permission|consent)"),
    (REMARK, "public-domain", "public", r"(?:in|into|to) the public domain"), (REMARK, "public-domain", "public", r"public domain (?:work|software|text|dedication)"),
    (REMARK, "all-rights-reserved", "rights", r"all rights reserved"), (REMARK, "some-rights-reserved", "rights", r"(?:some|certain) rights reserved"),
    (REMARK, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"), (REMARK, "copyright", "copyright", r"(?:c )?copyright (?:by|of|holders?)"),
    (REMARK, "creative-commons", "creative", r"creative commons(?: public)?(?: licen[cs]e)?"), (REMARK, "dual-license", "dual|multi", r"(?:dual|multi) licen[cs]ed"),
    (REMARK, "freeware", "freeware", r"(?:is|as) freeware"), (REMARK, "shareware", "shareware", r"(?:is|as) shareware"), (REMARK, "open-source", "license|licence", r"(?:an )?open source licen[cs]e"),
    (REMARK, "eula", "agreement", r"end user licen[cs]e agreement"), (REMARK, "terms-of-use", "terms", r"subject to (?:the |these |our )?terms (?:of (?:use|service)|and conditions)"),
    (TAG, "", "license|licence", r"not (?:be )?(?:licen[cs]ed|released|distributed|available|covered) (?:under|by) (?:the )?(?:\S+ ){1,6}?licen[cs]e"),
    (TAG, "", "gpl", r"not (?:be )?(?:licen[cs]ed|released|distributed|available|covered) (?:under|by) (?:the )?(?:gnu )?gpl(?: v?[23])?"),
    (TAG, "", "lgpl", r"not (?:be )?(?:licen[cs]ed|released|distributed|available|covered) (?:under|by) (?:the )?(?:gnu )?lgpl(?: v?[23])?"),
    (TAG, "", "agpl", r"not (?:be )?(?:licen[cs]ed|released|distributed|available|covered) (?:under|by) (?:the )?(?:gnu )?agpl(?: v?3)?"),
    (TAG, "", "compatible|incompatible", r"(?:gpl|mit|apache|bsd)(?: licen[cs]e)? (?:in)?compatible"), (TAG, "", "compatible|incompatible", r"(?:in)?compatible with the (?:\S+ ){1,6}?licen[cs]e"),
    (TAG, "", "driver", r"driver s licen[cs]e"), (TAG, "", "driving", r"driving licen[cs]e"), (TAG, "", "poetic|artistic", r"(?:poetic|artistic) licen[cs]e (?:with|to|in|and) (?:the )?(?:facts|truth|history)"),
)

#: The word forms that grant a licence.
GRANT_FORM = r"(?:licen[cs]ed|released|distributed|(?:made )?available|published|provided|covered|governed|issued|offered) (?:under|by) (?:(?:the )?terms of )?(?:the |a |an )?"
TAG_FORM = r"(?:spdx license identifier|license spdx|licen[cs]e id|licen[cs]e expression) "


def _pattern(words: str) -> str:
    """Over a text of words that stand between spaces of their own each."""
    return " (" + words.replace(r"\S+ ", r"[^ ]+ ").replace(" ", "  ") + ") "


@functools.cache
def rules() -> tuple[tuple[int, str, str, str], ...]:
    """(priority, label, keyword, pattern) of all rules, in order: four forms of each licence, then the phrases.

    One of the words of its keyword, parted by ``|``, stands in every match.
    """
    out = []
    for label, key, identifier, name, address in LICENSES:
        words = [w for w in address.split() if w.isalpha() and w not in ("org", "com", "net")]
        out += [(TAG, label, identifier.split()[0], TAG_FORM + identifier + "(?: only)?"), (GRANT, label, key, GRANT_FORM + name),
                (NAME, label, key, name), (ADDRESS, label, next((w for w in words if w.startswith("licen")), words[-1]), address)]
    out += PHRASES
    return tuple((p, label, key, _pattern(words)) for p, label, key, words in out)


def keywords() -> list[str]:
    return sorted({word for _, _, key, _ in rules() for word in key.split("|")})


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Other characters may change too, but stay beyond ASCII, which is all that words and rules tell apart."""
    upper = "".join(map(chr, range(65, 91)))
    # the only two characters whose lower case holds an ASCII letter
    mixed = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(mixed, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def words_apart(text: Column) -> Column:
    """The words of a text with two spaces between them."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, "  "))


def words_in(spaced: Column) -> Column:
    return F.regexp_count(spaced, F.lit("[^ ]+")).cast("long")


def places(spaced: Column, pattern: Column) -> Column:
    """array<struct<start, stop>>, in words, of the matches of a pattern, which must lie between spaces."""
    marked = F.regexp_replace(spaced, pattern, F.lit(" \x01$1\x02 "))
    words = F.split(F.trim(marked), "  ")
    at = lambda sign, test, more: F.filter(F.transform(words, lambda w, i: F.when(test(w, F.lit(sign)), i + more)), lambda i: i.isNotNull())
    return F.zip_with(at("\x01", F.startswith, 0), at("\x02", F.endswith, 1), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def _held(d: Column) -> Column:
    return F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["priority"].alias("priority"), d["label"].alias("label"))


def kept(found: Column) -> Column:
    """The intervals that stay of ``found`` (array<struct<start, back, priority, rule, stop, label>>), as array<struct<priority, label>>, distinct."""
    nothing = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.lit(TAG).alias("priority"), F.lit("").alias("label"))
    begin = F.struct(nothing.alias("held"), F.array().cast("array<struct<priority:int,label:string>>").alias("kept"))

    def with_held(state):
        what = F.struct(state["held"]["priority"].alias("priority"), state["held"]["label"].alias("label"))
        return F.when((state["held"]["label"] == "") | F.array_contains(state["kept"], what), state["kept"]).otherwise(F.array_append(state["kept"], what))

    def step(state, d):
        held = state["held"]
        beyond, inside = d["start"] >= held["stop"], d["stop"] <= held["stop"]
        better = ~inside & (d["priority"] < held["priority"])
        return F.struct(
            F.when(beyond | better, _held(d)).otherwise(held).alias("held"),
            F.when(beyond, with_held(state)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(F.sort_array(found), begin, step, with_held)


def _column(values) -> Column:
    """A constant array<string> of many values, planned as one constant."""
    return F.split(F.lit("\n".join(map(str, values))), "\n")


def detections(spaced: Column, hits: Column) -> Column:
    """All matches of the rules whose keyword is among ``hits``."""
    priority, label, key, pattern = map(_column, zip(*rules()))
    gated = F.filter(F.sequence(F.lit(0), F.lit(len(rules()) - 1)), lambda i: F.arrays_overlap(hits, F.split(F.get(key, i), r"\|")) & F.rlike(spaced, F.get(pattern, i)))
    return F.flatten(F.transform(gated, lambda i: F.transform(places(spaced, F.get(pattern, i)), lambda p: F.struct(
        p["start"].alias("start"), (-p["stop"]).alias("back"), F.get(priority, i).cast("int").alias("priority"), i.alias("rule"),
        p["stop"].alias("stop"), F.get(label, i).alias("label")))))


def scan(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``df`` with what their texts hold, and the names of these columns:

    n_words, n_base, first_word, last_word, base_labels and labels (arrays), score.
    """
    wanted = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    spaced, words, base, hits, kept_, *out = common.private(df, "spaced_words_", "words_", "base_found_", "keywords_hit_", "kept_", *wanted)
    names, s = dict(zip(wanted, out)), F.col(spaced)
    # in steps, so that what is used twice is worked out once
    rows = df.withColumn(spaced, words_apart(common.col(text)))
    rows = rows.withColumn(words, F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "  ")))
    rows = rows.withColumn(hits, F.array_intersect(words, _column(keywords()))).withColumn(spaced, F.concat(F.lit(" "), s, F.lit(" ")))
    phrases = [(" " + p.replace(" ", "  ") + " ", label) for p, label in BASE]

    def place(phrase: str, label: str) -> Column:
        n = (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(phrase), F.lit("")))) / len(phrase)
        first = words_in(F.substring_index(s, phrase, 1))
        last = F.size(words) - words_in(F.substring_index(s, phrase, -1)) - phrase.count("  ") - 1
        return F.when(F.contains(s, F.lit(phrase)), F.struct(n.cast("long").alias("n"), first.alias("first"), last.alias("last"), F.lit(label).alias("label")))

    places_ = F.array_compact(F.array(*[place(*p) for p in phrases]))
    rows = rows.withColumn(base, F.when(F.size(hits) > 0, places_).otherwise(F.array().cast("array<struct<n:bigint,first:bigint,last:bigint,label:string>>")))
    none = F.array().cast("array<struct<priority:int,label:string>>")
    rows = rows.withColumn(kept_, F.when(F.size(hits) > 0, kept(detections(s, F.col(hits)))).otherwise(none))
    scores = F.array(*map(F.lit, SCORES))
    best = F.greatest(F.when(F.size(base) > 0, BASE_SCORE).otherwise(0.0), F.coalesce(F.array_max(F.transform(kept_, lambda d: F.get(scores, d["priority"]))), F.lit(0.0)))
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    both = F.array_sort(F.array_union(base_labels, F.transform(kept_, lambda d: d["label"])))
    made = {
        "n_words": F.size(words).cast("long"), "n_base": F.aggregate(F.transform(base, lambda b: b["n"]), F.lit(0).cast("long"), lambda a, n: a + n),
        "first_word": F.array_min(F.transform(base, lambda b: b["first"])), "last_word": F.array_max(F.transform(base, lambda b: b["last"])),
        "base_labels": base_labels, "labels": both, "score": best,
    }
    return rows.select(*[common.col(c) for c in df.columns], *[made[w].alias(names[w]) for w in wanted]), names
