"""Licence and exception identifiers (fixed values: identifiers of the public SPDX list that sources use most)."""

LICENSES = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later
Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1
bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5
CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0
EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only
GPL-3.0-or-later HPND ICU IJG ImageMagick IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng libpng-2.0 LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MIT-CMU
MIT-Modern-Variant MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA NIST-PD NPL-1.1 ODbL-1.0
ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0
QPL-1.0 Ruby SGI-B-2.0 Sleepycat SMLNJ SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C Watcom-1.0 WTFPL
X11 Zend-2.0 Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1 NONE NOASSERTION
""".lower().split()

EXCEPTIONS = """
389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0
CLISP-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0
freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception GPL-CC-1.0
i2p-gpl-java-exception LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception
mif-exception OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 openvpn-openssl-exception PS-or-PDF-font-exception-20170817
Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0
WxWindows-exception-3.1
""".lower().split()
