"""Licence signature rules, written by hand: labels, and under each the lines ``tier needs: pattern``.

A pattern is a regular expression by words: every token must fit one whole word (a run of ASCII letters and digits and of
characters beyond ASCII, in lower case), ``~token`` may be missing and ``..n`` stands for up to n words. Punctuation and line
breaks never matter, so "Apache-2.0", "Apache 2.0" and "/licenses/LICENSE-2.0" are the words "apache 2 0", "apache 2 0" and
"licenses license 2 0". ``needs`` are words that any match must hold, the rarest first: a text without them never runs the
pattern. Tiers: 4 machine-readable identifiers, 3 sentences of a licence's own text, 2 names with a version or an address,
1 names, 0 hints.
"""

from __future__ import annotations

from dataclasses import dataclass

SIGNATURES = """
apache-2.0
  4 spdx apache: spdx license identifier apache 2 0
  3 apache licensed: licensed under the apache license version 2 0 the license you may not use
  3 apache obtain: you may obtain a copy of the license at https? ~www apache org licenses license 2 0
  2 apache license: ~the apache ~software licen[cs]e ~version v?2 ~0
  2 apache: apache v?2 0 ~licen[cs]e
  2 apache licenses: apache org licenses license 2 0 ~txt ~html
  2 asl: asl v?2 ~0
  2 apache lizenz: apache lizenz ~version v?2 ~0
  2 apache licence: licence apache ~version v?2 ~0
  2 apache licencia: licencia apache ~versión ~version v?2 ~0
apache-1.1
  2 apache license: apache ~software license ~version 1 1
  3 apache product: this product includes software developed by the apache software foundation
apache-1.0
  2 apache license: apache ~software license ~version 1 0
apache
  1 apache license: ~the apache ~software licen[cs]e
  1 apache licensed: licensed under ~the apache
  0 asf: licensed to the apache software foundation asf under one or more contributor
mit
  4 spdx mit: spdx license identifier mit
  3 permission charge: permission is hereby granted free of charge to any person obtaining a copy of this software
  3 copyright permission: the above copyright notice and this permission notice shall be included in all copies or substantial portions
  2 license mit: ~released ~licensed ~distributed ~available ~under ~the ~terms ~of ~the mit licen[cs]e
  2 opensource mit: opensource org licenses mit ~license ~php
  2 mit lizenz: ~unter ~der mit lizenz
  2 licence mit: ~sous licence mit
  2 licencia mit: ~bajo ~la licencia mit
  1 licensed mit: licensed under ~the mit
  1 expat license: expat licen[cs]e
mit-0
  4 spdx mit: spdx license identifier mit 0
  2 mit attribution: mit no attribution ~licen[cs]e
x11
  2 x11 license: x11 licen[cs]e
  3 consortium advertising: except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-2-clause
  4 spdx bsd: spdx license identifier bsd 2 clause
  2 clause bsd: 2 clause bsd ~licen[cs]e
  2 bsd clause: bsd 2 clause ~licen[cs]e
  2 simplified bsd: simplified bsd licen[cs]e
  2 freebsd license: freebsd licen[cs]e
bsd-3-clause
  4 spdx bsd: spdx license identifier bsd 3 clause
  2 clause bsd: 3 clause bsd ~licen[cs]e
  2 bsd clause: bsd 3 clause ~licen[cs]e
  2 revised bsd: revised bsd licen[cs]e
  2 modified bsd: modified bsd licen[cs]e
  2 bsd new: new bsd licen[cs]e
  3 endorse contributors: neither the name of ..12 nor the names of its contributors may be used to endorse or promote
bsd-4-clause
  4 spdx bsd: spdx license identifier bsd 4 clause
  2 bsd clause: bsd 4 clause ~licen[cs]e
  2 original bsd: original bsd licen[cs]e
  3 advertising acknowledgement: all advertising materials mentioning features or use of this software must display the following acknowledgement
0bsd
  4 spdx 0bsd: spdx license identifier 0bsd
  2 0bsd: ~the 0bsd ~licen[cs]e
  2 zero clause: zero clause bsd ~licen[cs]e
bsd
  1 bsd license: ~the bsd ~style licen[cs]e
  1 bsd licensed: licensed under ~the bsd
  2 bsd lizenz: bsd lizenz
  3 redistribution permitted: redistribution and use in source and binary forms with or without modification are permitted
  3 redistributions retain: redistributions of source code must retain the above copyright notice
isc
  4 spdx isc: spdx license identifier isc
  2 isc license: ~the isc licen[cs]e
  3 permission copy: permission to use copy modify and ~or distribute this software for any purpose with or without fee is hereby granted
zlib
  4 spdx zlib: spdx license identifier zlib
  2 zlib license: zlib ~libpng licen[cs]e
  3 warranty implied: this software is provided as is without any express or implied warranty in no event will the authors
libpng
  2 libpng license: libpng licen[cs]e
bsl-1.0
  4 spdx bsl: spdx license identifier bsl 1 0
  2 boost license: boost software licen[cs]e ~version ~1 ~0
  2 boost license_1_0: boost org license_1_0 ~txt
unlicense
  4 spdx unlicense: spdx license identifier unlicense
  2 unlicense: ~the unlicense
  3 unencumbered domain: this is free and unencumbered software released into the public domain
wtfpl
  4 spdx wtfpl: spdx license identifier wtfpl
  2 wtfpl: ~the wtfpl
  2 fuck license: do what the fuck you want to public licen[cs]e
beerware
  2 beerware: ~the beerware ~licen[cs]e
  2 beer license: the beer ware licen[cs]e
cc0-1.0
  4 spdx cc0: spdx license identifier cc0 1 0
  2 cc0: cc0 ~1 ~0 ~universal
  2 creativecommons publicdomain: creativecommons org publicdomain zero 1 0
  2 creative zero: creative commons zero ~v?1 ~0 ~universal
cc-by-4.0
  4 spdx cc: spdx license identifier cc by 4 0
  2 cc by: cc by v?4 0 ~international
  2 creativecommons by: creativecommons org licenses by 4 0
  2 creative attribution: creative commons attribution 4 0 ~international
cc-by-3.0
  2 cc by: cc by v?3 0 ~unported
  2 creativecommons by: creativecommons org licenses by 3 0
  2 creative attribution: creative commons attribution 3 0 ~unported
cc-by-2.5
  2 cc by: cc by 2 5
  2 creativecommons by: creativecommons org licenses by 2 5
  2 creative attribution: creative commons attribution 2 5 ~generic
cc-by-2.0
  2 cc by: cc by 2 0
  2 creativecommons by: creativecommons org licenses by 2 0
  2 creative attribution: creative commons attribution 2 0 ~generic
cc-by-sa-4.0
  4 spdx sa: spdx license identifier cc by sa 4 0
  2 sa cc: cc by sa v?4 0 ~international
  2 creativecommons sa: creativecommons org licenses by sa 4 0
  2 sharealike creative: creative commons attribution sharealike 4 0 ~international
cc-by-sa-3.0
  2 sa cc: cc by sa v?3 0 ~unported
  2 creativecommons sa: creativecommons org licenses by sa 3 0
  2 sharealike creative: creative commons attribution sharealike 3 0 ~unported
cc-by-sa
  1 sa cc: cc by sa
  1 attribution share: ~creative ~commons attribution share ~alike
  1 sharealike creative: creative commons attribution sharealike
cc-by-nd-4.0
  2 nd cc: cc by nd v?4 0
  2 creativecommons nd: creativecommons org licenses by nd 4 0
  2 noderivatives creative: creative commons attribution noderivatives 4 0
cc-by-nd
  1 nd cc: cc by nd
  1 noderivatives creative: creative commons attribution noderivatives
cc-by-nc-4.0
  4 spdx nc: spdx license identifier cc by nc 4 0
  2 nc cc: cc by nc v?4 0 ~international
  2 creativecommons nc: creativecommons org licenses by nc 4 0
  2 noncommercial creative: creative commons attribution noncommercial 4 0
cc-by-nc-3.0
  2 nc cc: cc by nc v?3 0
  2 creativecommons nc: creativecommons org licenses by nc 3 0
  2 noncommercial creative: creative commons attribution noncommercial 3 0
cc-by-nc
  1 nc cc: cc by nc
  1 noncommercial creative: creative commons attribution noncommercial
cc-by-nc-sa-4.0
  2 nc sa cc: cc by nc sa v?4 0
  2 creativecommons nc sa: creativecommons org licenses by nc sa 4 0
  2 noncommercial sharealike: creative commons attribution noncommercial sharealike 4 0
cc-by-nc-sa
  1 nc sa cc: cc by nc sa
  1 noncommercial sharealike: creative commons attribution noncommercial sharealike
cc-by-nc-nd-4.0
  2 nc nd cc: cc by nc nd v?4 0
  2 creativecommons nc nd: creativecommons org licenses by nc nd 4 0
  2 noncommercial noderivatives: creative commons attribution noncommercial noderivatives 4 0
cc-by-nc-nd
  1 nc nd cc: cc by nc nd
  1 noncommercial noderivatives: creative commons attribution noncommercial noderivatives
cc-by
  1 creative attribution: creative commons attribution ~licen[cs]e
creative-commons
  0 creative commons: ~a creative commons ~licen[cs]e
  0 creativecommons: creativecommons org ~licenses
gpl-1.0
  4 spdx gpl: spdx license identifier gpl 1 0 ~only ~or ~later
  2 general public: ~gnu general public licen[cs]e ~version v?1 ~0
gpl-2.0
  4 spdx gpl: spdx license identifier gpl 2 0 ~only ~or ~later
  2 general public: ~gnu general public licen[cs]e ~version v?2 ~0
  2 gpl: ~gnu gpl ~version v?2 ~0
  2 gplv2: ~gnu gplv2
  3 redistribute gnu: you can redistribute it and or modify it under the terms of the gnu general public license ..10 version 2
gpl-2.0-or-later
  3 gnu later: gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
  2 gpl: gpl ~version v?2 ~0 or ~any later ~version
  2 gplv2: gplv2 or later
gpl-3.0
  4 spdx gpl: spdx license identifier gpl 3 0 ~only ~or ~later
  2 general public: ~gnu general public licen[cs]e ~version v?3 ~0
  2 gpl: ~gnu gpl ~version v?3 ~0
  2 gplv3: ~gnu gplv3
gpl-3.0-or-later
  3 gnu later: gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
  2 gpl: gpl ~version v?3 ~0 or ~any later ~version
  2 gplv3: gplv3 or later
gpl
  1 gpl: ~gnu gpl
  2 gnu licenses: gnu org licenses gpl ~3 ~2 ~0 ~html ~txt
  3 gnu details: see the gnu general public license for more details
  3 gnu received: you should have received a copy of the gnu general public license
lgpl-2.1
  4 spdx lgpl: spdx license identifier lgpl 2 1 ~only ~or ~later
  2 lesser public: ~gnu lesser general public licen[cs]e ~version v?2 1
  2 lgpl: ~gnu lgpl ~version v?2 1
lgpl-2.0
  2 library public: ~gnu library general public licen[cs]e ~version ~v?2 ~0
lgpl-3.0
  4 spdx lgpl: spdx license identifier lgpl 3 0 ~only ~or ~later
  2 lesser public: ~gnu lesser general public licen[cs]e ~version v?3 ~0
  2 lgpl: ~gnu lgpl ~version v?3 ~0
  2 lgplv3: ~gnu lgplv3
lgpl
  1 lesser public: ~gnu lesser general public licen[cs]e
  1 lgpl: ~gnu lgpl
agpl-3.0
  4 spdx agpl: spdx license identifier agpl 3 0 ~only ~or ~later
  2 affero public: ~gnu affero general public licen[cs]e ~version v?3 ~0
  2 agpl: ~gnu agpl ~version v?3 ~0
  2 agplv3: ~gnu agplv3
agpl
  1 affero public: ~gnu affero general public licen[cs]e
  1 agpl: ~gnu agpl
gfdl-1.3
  4 spdx gfdl: spdx license identifier gfdl 1 3
  2 documentation gnu: gnu free documentation licen[cs]e ~version 1 3
gfdl-1.2
  2 documentation gnu: gnu free documentation licen[cs]e ~version 1 2
gfdl
  1 documentation gnu: gnu free documentation licen[cs]e
  1 gfdl: ~gnu gfdl
mpl-2.0
  4 spdx mpl: spdx license identifier mpl 2 0
  3 mozilla source: this source code form is subject to the terms of the mozilla public license v 2 0
  2 mozilla public: mozilla public licen[cs]e ~version v?2 ~0
  2 mozilla mpl: mozilla org mpl 2 0
  2 mpl: mpl v?2 0
mpl-1.1
  2 mozilla public: mozilla public licen[cs]e ~version 1 1
  2 mpl: mpl 1 1
mpl
  1 mozilla public: mozilla public licen[cs]e
epl-2.0
  4 spdx epl: spdx license identifier epl 2 0
  2 eclipse public: eclipse public licen[cs]e ~version v?2 ~0
  2 epl: epl v?2 0
epl-1.0
  2 eclipse public: eclipse public licen[cs]e ~version v?1 ~0
  2 epl: epl v?1 0
epl
  1 eclipse public: eclipse public licen[cs]e
edl-1.0
  2 eclipse distribution: eclipse distribution licen[cs]e
cpl-1.0
  2 common public: common public licen[cs]e ~version ~1 ~0
cpal-1.0
  2 attribution common: common public attribution licen[cs]e
ipl-1.0
  2 ibm public: ibm public licen[cs]e
cddl-1.1
  2 cddl: cddl ~version 1 1
  2 common distribution: common development and distribution licen[cs]e ~version 1 1
cddl-1.0
  4 spdx cddl: spdx license identifier cddl 1 0
  2 cddl: cddl ~version 1 0
  2 common distribution: common development and distribution licen[cs]e ~version 1 0
cddl
  1 cddl: ~the cddl
  1 common distribution: common development and distribution licen[cs]e
eupl-1.2
  4 spdx eupl: spdx license identifier eupl 1 2
  2 eupl: eupl ~version v?1 2
  2 european public: european union public licen[cs]e ~version v?1 2
eupl
  1 eupl: ~the eupl
  1 european public: european union public licen[cs]e
cecill
  2 cecill: cecill ~b ~c ~licen[cs]e ~version ~2 ~1
artistic-2.0
  4 spdx artistic: spdx license identifier artistic 2 0
  2 artistic license: artistic licen[cs]e ~version v?2 ~0
artistic
  1 artistic license: ~the artistic licen[cs]e
perl
  3 perl terms: under the same terms as perl itself
psf-2.0
  4 spdx psf: spdx license identifier psf 2 0
  2 python license: python ~software ~foundation licen[cs]e ~version ~2
  1 psf license: psf licen[cs]e
ruby
  2 ruby license: ~the ruby licen[cs]e
php-3.01
  2 php license: php licen[cs]e ~version 3 0?1
php
  1 php license: ~the php licen[cs]e
openssl
  2 openssl license: openssl licen[cs]e
  3 openssl toolkit: this product includes software developed by the openssl project for use in the openssl toolkit
ssleay
  2 ssleay license: original ssleay licen[cs]e
curl
  2 curl license: ~the curl licen[cs]e
ofl-1.1
  4 spdx ofl: spdx license identifier ofl 1 1
  2 sil font: sil open font licen[cs]e ~version ~1 ~1
  1 ofl: ~sil ofl ~1 ~1
ubuntu-font
  2 ubuntu font: ubuntu font licen[cs]e
odbl-1.0
  4 spdx odbl: spdx license identifier odbl 1 0
  2 database license: open ~data ~commons ~open database licen[cs]e ~odbl
  2 opendatacommons odbl: opendatacommons org licenses odbl
  1 odbl: ~the odbl ~v?1 ~0
odc-by
  2 opendatacommons by: opendatacommons org licenses by
  2 data attribution: open data commons attribution licen[cs]e
  2 odc by: odc by ~1 ~0
pddl-1.0
  2 dedication domain: public domain dedication and licen[cs]e
  1 pddl: ~odc pddl
cdla-permissive
  2 cdla permissive: cdla permissive ~1 ~2 ~0
  2 community permissive: community data licen[cs]e agreement permissive
cdla-sharing
  2 cdla sharing: cdla sharing ~1 ~0
  2 community sharing: community data licen[cs]e agreement sharing
ogl-uk
  2 ogl: ogl ~uk v?[123] ~0
  2 government open: open government licen[cs]e ~v?[123] ~0
sspl-1.0
  4 spdx sspl: spdx license identifier sspl 1 0
  2 server public: server side public licen[cs]e
  1 sspl: ~the sspl
busl-1.1
  4 spdx busl: spdx license identifier busl 1 1
  2 business source: business source licen[cs]e ~version ~1 ~1
elastic-2.0
  4 spdx elastic: spdx license identifier elastic 2 0
  2 elastic license: elastic licen[cs]e ~version ~v?2 ~0
commons-clause
  2 clause commons: commons clause ~licen[cs]e ~condition
  3 sell grant: the grant of rights under the license will not include and the license does not grant to you the right to sell
openrail
  2 openrail: ~bigscience ~creativeml openrail ~m
  2 responsible ai: responsible ai licen[cs]e
llama-community
  2 llama community: llama ~[1-4] community licen[cs]e ~agreement
gemma-terms
  2 gemma terms: gemma terms of use
json
  3 evil software: the software shall be used for good not evil
ncsa
  4 spdx ncsa: spdx license identifier ncsa
  2 ncsa: university of illinois ncsa open source licen[cs]e
afl-3.0
  2 academic license: academic free licen[cs]e ~version ~v?3 ~0
osl-3.0
  2 open license: open software licen[cs]e ~version v?3 ~0
ms-pl
  2 microsoft public: microsoft public licen[cs]e
  1 ms pl: ms pl
ms-rl
  2 microsoft reciprocal: microsoft reciprocal licen[cs]e
postgresql
  2 postgresql license: ~the postgresql licen[cs]e
unicode-dfs
  2 unicode license: unicode ~inc ~data ~files ~and ~software licen[cs]e ~agreement
w3c
  2 w3c license: w3c ~software ~document ~notice ~and licen[cs]e
lppl-1.3
  2 latex project: latex project public licen[cs]e ~version ~1 ~3c?
  1 lppl: ~the lppl
sleepycat
  2 sleepycat license: sleepycat licen[cs]e
qpl-1.0
  2 q public: ~the q public licen[cs]e
vim
  2 vim license: ~the vim licen[cs]e
freetype
  2 freetype license: freetype ~project licen[cs]e
icu
  2 icu license: icu licen[cs]e
hpnd
  2 historical permission: historical permission notice and disclaimer
bzip2
  2 bzip2 license: bzip2 licen[cs]e
tcl
  2 tcl license: tcl tk licen[cs]e
info-zip
  2 info zip: info zip licen[cs]e
npl
  2 netscape public: netscape public licen[cs]e
upl-1.0
  2 universal permissive: universal permissive licen[cs]e
mulan-psl-2.0
  2 mulan permissive: mulan permissive software licen[cs]e
vsl
  2 vovida license: vovida software licen[cs]e
zpl-2.1
  2 zope public: zope public licen[cs]e
public-domain
  1 domain public: ~released ~into ~in ~the public domain
  1 domaine public: ~dans ~le domaine public
  1 gemeinfrei: ~ist gemeinfrei
  1 dominio público: ~de dominio público
proprietary
  1 proprietary confidential: proprietary and confidential
  1 proprietary license: ~a proprietary licen[cs]e
  1 unauthorized copying: unauthorized copying ..8 is strictly prohibited
  1 trade secrets: contains ~valuable ~confidential trade secrets
  1 reproduced permission: may ~not be reproduced ..12 without ~the ~prior ~express written permission
  1 redistribution prohibited: redistribution ..6 is ~strictly prohibited
  1 eula: ~the eula
  1 user license: end user licen[cs]e agreement
reserved
  1 réservés droits: tous droits réservés
  1 rechte vorbehalten: alle rechte vorbehalten
  1 derechos reservados: todos los derechos reservados
non-commercial
  0 only use: for non ~commercial ~noncommercial use only
  0 noncommercial use: noncommercial use ~only
research-only
  0 research only: for research ~purposes ~use only
  0 academic only: for academic ~research ~use ~purposes only
copyright
  0 copyright: copyright ~c ~© (?:19|20)[0-9]{2} ~(?:19|20)[0-9]{2}
  0 copyright: copyright ~c ~© ~(?:by|holder|holders|owner|owners)
  0 ©: © (?:19|20)[0-9]{2}
licensed
  0 licensed under: ~is ~are licensed under
  0 terms under: under the terms of ~the ~this ~a ~following licen[cs]e
  0 lizenz unter: unter ..3 lizenz
  0 licence sous: sous licence
  0 licencia bajo: bajo ~la ~una licencia
"""

#: The phrases of the contract, which no other rule suppresses.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What a surviving detection of each tier is worth.
CONFIDENCE = (0.3, 0.6, 0.8, 0.95, 1.0)


@dataclass(frozen=True)
class Rule:
    """``regex`` runs over texts whose every word stands between two blanks of its own. Of each of ``needs``, one must be a word of the text."""

    number: int
    label: str
    tier: int
    needs: tuple[tuple[str, ...], ...]
    regex: str
    base: bool = False


def by_words(pattern: str) -> str:
    """The regular expression of a pattern: each token with the blanks of its word."""
    out = ""
    for token in pattern.split():
        if token.startswith(".."):
            out += f"(?: [^ ]+ ){{0,{token[2:]}}}"
        else:
            out += f"(?: (?:{token[1:]}) )?" if token.startswith("~") else f" (?:{token}) "
    return out


def spellings(need: str, pattern: str) -> tuple[str, ...]:
    """The words that a need stands for: itself, or both spellings where the pattern allows them."""
    tokens = pattern.split()
    if need == "license" and "licen[cs]e" in tokens:
        return "licence", "license"
    if need not in tokens:
        raise ValueError(f"{need} is not in every match of {pattern}")
    return (need,)


def parse(text: str) -> list[tuple[str, int, tuple[tuple[str, ...], ...], str]]:
    """label, tier, needs and pattern of every rule line."""
    out, label = [], ""
    for line in filter(str.strip, text.split("\n")):
        if not line.startswith(" "):
            label = line.strip()
            continue
        head, _, pattern = line.strip().partition(": ")
        tier, *needs = head.split()
        out.append((label, int(tier), tuple(spellings(n, pattern) for n in needs), pattern))
    return out


def rules(text: str = SIGNATURES) -> list[Rule]:
    """The base phrases first, then every signature; the number is the order that decides ties."""
    base = [(label, 1, tuple((w,) for w in sorted(phrase.split(), key=len, reverse=True)), phrase) for phrase, label in BASE.items()]
    return [Rule(i, label, tier, needs, by_words(pattern), i < len(base)) for i, (label, tier, needs, pattern) in enumerate([*base, *parse(text)])]
