"""Signature rules of licenses: ordered patterns over normalised words, each behind a keyword.

A pattern is written over words with one space between them (lower-cased A-Z, digits and
non-ASCII letters; everything else separates). Optional words carry their space in front:
``apache license(?: version)? 2(?: 0)?``. ``spread`` turns it into a regex over
normalised text, where every word has a space of its own on both sides, so that matches
can stand side by side and no lookahead is needed.

Every match of a rule holds one of the rule's keywords, so a text without them can't match.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    pattern: str
    keywords: str  # words, of which every match holds one at least
    priority: int  # 0 suppresses 1, 2 and 3 inside its interval, and so on
    relevance: float
    base: bool = False


# The agreed phrases with their labels.
BASE = [
    ("gpl", "gnu general public license", "gnu"),
    ("apache", "apache license", "apache"),
    ("cc-by", "cc by", "cc"),
    ("mit", "mit license", "mit"),
]

# Label, pattern of the short identifier, pattern of the name, words of which every name holds one, words of which every identifier holds one.
FAMILIES = [
    ("gpl-1.0", "(?:gpl 1(?: 0)?|gpl v1|gplv1|gpl1)(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)? version 1(?: 0)?", "gnu", "gpl gplv1 gpl1"),
    ("gpl-2.0", "(?:gpl 2(?: 0)?|gpl v2|gplv2|gpl2)(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version 2| v2)(?: 0)?", "gnu", "gpl gplv2 gpl2"),
    ("gpl-3.0", "(?:gpl 3(?: 0)?|gpl v3|gplv3|gpl3)(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version 3| v3)(?: 0)?", "gnu", "gpl gplv3 gpl3"),
    ("lgpl-2.0", "(?:lgpl 2 0|lgplv2 0)(?: only| or later)?", "gnu library general public license(?: version 2(?: 0)?)?", "library", "lgpl lgplv2"),
    ("lgpl-2.1", "(?:lgpl 2 1|lgplv2 1)(?: only| or later)?", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1", "lesser", "lgpl lgplv2"),
    ("lgpl-3.0", "(?:lgpl 3(?: 0)?|lgplv3)(?: only| or later)?", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?", "lesser", "lgpl lgplv3"),
    ("agpl-3.0", "(?:agpl 3(?: 0)?|agplv3)(?: only| or later)?", "gnu affero general public license(?: version 3(?: 0)?)?", "affero", "agpl agplv3"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "gnu free documentation license(?: version 1 3)?", "documentation", "gfdl"),
    ("apache-1.1", "apache 1 1", "apache(?: software)? license version 1 1", "apache", "apache"),
    ("apache-2.0", "apache 2(?: 0)?", "apache license(?: version)? 2(?: 0)?", "apache", "apache"),
    ("mit-0", "mit 0", "mit no attribution license", "attribution", "mit"),
    ("mit", "mit", "mit(?: open source)? license", "mit", "mit"),
    ("isc", "isc", "isc license", "isc", "isc"),
    ("0bsd", "0bsd", "zero clause bsd license", "bsd", "0bsd"),
    ("bsd-2-clause", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?", "bsd", "bsd"),
    ("bsd-3-clause", "bsd 3 clause", "(?:bsd 3 clause|3 clause bsd|modified bsd|new bsd)(?: license)?", "bsd", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd", "bsd"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license(?: version)? 1 1", "mozilla", "mpl"),
    ("mpl-2.0", "mpl 2(?: 0)?", "mozilla public license(?: version| v)?(?: 2(?: 0)?)?", "mozilla", "mpl"),
    ("epl-1.0", "epl 1 0", "eclipse public license(?: version| v)? 1(?: 0)?", "eclipse", "epl"),
    ("epl-2.0", "epl 2 0", "eclipse public license(?: version| v)? 2(?: 0)?", "eclipse", "epl"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license(?: version 1 0)?", "development", "cddl"),
    ("cpl-1.0", "cpl 1 0", "common public license(?: version 1 0)?", "common", "cpl"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: v| version)?(?: 1 2)?", "european", "eupl"),
    ("artistic-1.0", "artistic 1 0", "artistic license 1 0", "artistic", "artistic"),
    ("artistic-2.0", "artistic 2 0", "artistic license(?: 2 0)?", "artistic", "artistic"),
    ("bsl-1.0", "bsl 1 0", "boost software license(?: version)?(?: 1 0)?", "boost", "bsl"),
    ("busl-1.1", "busl 1 1", "business source license(?: version)?(?: 1 1)?", "business", "busl"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib", "zlib"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", "fuck", "wtfpl"),
    ("cc0-1.0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?", "cc0", "cc0"),
    ("cc-by-2.0", "cc by 2 0", "(?:cc by|creative commons attribution) 2 0", "cc creative", "cc"),
    ("cc-by-3.0", "cc by 3 0", "(?:cc by|creative commons attribution) 3 0", "cc creative", "cc"),
    ("cc-by-4.0", "cc by 4 0", "(?:cc by|creative commons attribution) 4 0", "cc creative", "cc"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creative commons attribution share ?alike 3 0", "creative", "cc"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creative commons attribution share ?alike 4 0", "creative", "cc"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creative commons attribution no ?deriv(?:s|atives) 4 0", "creative", "cc"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "creative commons attribution non ?commercial 3 0", "creative", "cc"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creative commons attribution non ?commercial 4 0", "creative", "cc"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0", "creative", "cc"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0", "creative", "cc"),
    ("odbl-1.0", "odbl 1 0", "open (?:data commons open )?database license(?: v1 0| 1 0)?", "database", "odbl"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution license(?: v1 0| 1 0)?", "commons", "odc"),
    ("ofl-1.1", "ofl 1 1", "sil open font license(?: version)?(?: 1 1)?", "font", "ofl"),
    ("ms-pl", "ms pl", "microsoft public license", "microsoft", "ms"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql", "postgresql"),
    ("python-2.0", "(?:python|psf) 2 0", "python software foundation license(?: version 2)?", "python", "python psf"),
    ("ruby", "ruby", "ruby license", "ruby", "ruby"),
    ("php-3.01", "php 3 01", "php license(?: version 3 01)?", "php", "php"),
    ("openssl", "openssl", "openssl license", "openssl", "openssl"),
    ("openrail-m", "openrail m", "(?:creativeml |bigcode |bigscience )?open ?rail(?: m)?(?: license)?", "openrail rail", "openrail"),
    ("llama-2", "llama 2", "llama 2 community license(?: agreement)?", "llama", "llama"),
]

# Label, words of the license's address, a word of it.
ADDRESSES = [
    ("gpl-2.0", "gnu org licenses(?: old licenses)? gpl 2 0", "gpl"),
    ("gpl-3.0", "gnu org licenses gpl 3 0", "gpl"),
    ("gpl", "gnu org (?:licenses|copyleft) gpl", "gpl"),
    ("lgpl", "gnu org (?:licenses|copyleft) lgpl", "lgpl"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0", "lgpl"),
    ("agpl-3.0", "gnu org licenses agpl(?: 3 0)?", "agpl"),
    ("gfdl", "gnu org (?:licenses|copyleft) fdl", "fdl"),
    ("apache-2.0", "(?:www )?apache org licenses license 2 0", "apache"),
    ("apache-2.0", "opensource org licenses apache 2 0", "opensource"),
    ("mit", "opensource org licenses mit(?: license)?", "opensource"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", "opensource"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", "opensource"),
    ("isc", "opensource org licenses isc", "opensource"),
    ("artistic-2.0", "opensource org licenses artistic(?: license)? 2 0", "opensource"),
    ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0", "mozilla"),
    ("mpl-1.1", "mozilla org mpl mpl 1 1", "mozilla"),
    ("epl-1.0", "eclipse org legal epl v10", "eclipse"),
    ("epl-2.0", "eclipse org legal epl (?:2 0|v20)", "eclipse"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("cc-pdm-1.0", "creativecommons org publicdomain mark 1 0", "creativecommons"),
    ("cc-by-2.0", "creativecommons org licenses by 2 0", "creativecommons"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0", "creativecommons"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", "creativecommons"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0", "creativecommons"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", "creativecommons"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0", "creativecommons"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0", "creativecommons"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0", "creativecommons"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0", "creativecommons"),
    ("odbl-1.0", "opendatacommons org licenses odbl", "opendatacommons"),
    ("odc-by-1.0", "opendatacommons org licenses by", "opendatacommons"),
    ("bsl-1.0", "boost org license 1 0", "boost"),
    ("unlicense", "unlicense org", "unlicense"),
    ("ofl-1.1", "scripts sil org ofl", "ofl"),
    ("wtfpl", "wtfpl net", "wtfpl"),
    ("zlib", "zlib net zlib license", "zlib"),
]

# Label, a passage of the license's own text, a word of it.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd-3-clause", "neither the name of [^ ]+(?: [^ ]+)?(?: [^ ]+)?(?: [^ ]+)?(?: [^ ]+)? nor the names of its contributors may be used to endorse", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", "agreed"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "gnu"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "lesser"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program", "affero"),
    ("gpl-2.0", "either version 2(?: of the license)? or (?:at your option )?any later version", "either"),
    ("gpl-3.0", "either version 3(?: of the license)? or (?:at your option )?any later version", "either"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", "eclipse"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "accompanying"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim"),
    ("proprietary", "all rights reserved(?: unauthorized)? (?:copying|reproduction|redistribution)", "reserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized"),
]

# General mentions, by label.
MENTIONS = [
    ("gpl", "(?:under|of) the gpl", "gpl"),
    ("lgpl", "(?:under|of) the lgpl", "lgpl"),
    ("gpl", "gnu gpl", "gnu"),
    ("lgpl", "gnu lesser general public license", "lesser"),
    ("agpl", "gnu affero general public license", "affero"),
    ("bsd", "bsd(?: style)? license", "bsd"),
    ("mpl", "mozilla public license", "mozilla"),
    ("epl", "eclipse public license", "eclipse"),
    ("cc-by-sa", "cc by sa", "cc"),
    ("cc-by-nd", "cc by nd", "cc"),
    ("cc-by-nc", "cc by nc(?: 4)?", "cc"),
    ("cc-by-nc-sa", "cc by nc sa", "cc"),
    ("cc-by-nc-nd", "cc by nc nd", "cc"),
    ("creative-commons", "creative commons licen[cs]e", "creative"),
    ("public-domain", "public domain", "domain"),
]

#: What stands before a name in a grant.
_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? "


def _rules() -> list[Rule]:
    rules = [Rule(label, phrase, word, 3, 0.5, True) for label, phrase, word in BASE]
    for label, short, name, name_words, short_words in FAMILIES:
        rules += [
            Rule(label, f"spdx license identifier {short}", short_words, 0, 1.0),
            Rule(label, f"licen[cs]e(?: id| name| type)? {short}", short_words, 2, 0.7),
            Rule(label, _GRANT + name, name_words, 1, 0.9),
            Rule(label, name, name_words, 2, 0.8),
        ]
    rules += [Rule(label, pattern, word, 0, 0.95) for label, pattern, word in ADDRESSES]
    rules += [Rule(label, pattern, word, 1, 0.9) for label, pattern, word in PASSAGES]
    rules += [Rule(label, _GRANT + pattern, word, 2, 0.7) for label, pattern, word in MENTIONS]
    rules += [Rule(label, pattern, word, 3, 0.5) for label, pattern, word in MENTIONS]
    return rules


RULES = _rules()


def spread(pattern: str) -> str:
    """The rule's regex over normalised text, where a space stands on both sides of every word."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "
