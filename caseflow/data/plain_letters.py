"""Characters that the label collation holds equal to plain ones.

Under UNICODE_CI_AI a text is compared by the letters, digits and signs that it shows: case,
accents and characters that show nothing do not count. These are all the characters that it
holds equal to nothing, to one printable ASCII character or blank, or to several; none other
can make a text equal to a plain one, but for a middle dot right after an l, which is
part of that letter. Code points are hexadecimal, with ranges; the tests compare all of
Unicode with the collation of the Spark at hand.
"""

from __future__ import annotations

# Equal to nothing.
IGNORED = (
        "0-8 E-1F 7F-84 86-9F AD 300-362 483-489 591-5BD 5BF 5C1-5C2 5C4-5C5 5C7 "
        "600-605 610-61A 61C 640 64B-65F 670 6D6-6DD 6DF-6E4 6E7-6E8 6EA-6ED 70F 711 "
        "730-74A 7EB-7F3 7FA 7FD 818-819 81C-82D 859-85B 890-891 897-89F 8CA-903 93C "
        "951-954 981-983 9BC 9FE A01-A03 A3C A70-A71 A81-A83 ABC AFA-AFF B01-B03 B3C "
        "B55 B82 C00-C04 C3C C81-C83 CBC CF3 D00-D03 D81-D83 E47-E4E EC8-ECE F18-F19 "
        "F35 F37 F39 F3E-F3F F7E-F7F F82-F83 F86-F87 FC6 1036-1038 135D-135F 17B4-17B5 "
        "17C6-17D1 17D3 17DD 180A-180F 1939-193B 1A74-1A7C 1A7F 1AB0-1ABE 1AC1-1ACB "
        "1B00-1B04 1B34 1B6B-1B73 1B80-1B82 1BE6 1C37 1CD0-1CE8 1CED 1CF2-1CF4 "
        "1CF7-1CF9 1DC0-1DC9 1DCB-1DD1 1DF5-1DFF 200B-200F 202A-202E 2060-2064 "
        "2066-206F 20D0-20F0 2CEF-2CF1 2D7F 302A-302F 3099-309A A66F-A672 A67C-A67D "
        "A6F0-A6F1 A80B A880-A881 A8C5 A8E0-A8F1 A92B-A92D A980-A983 A9B3 AABF AAC1 "
        "ABEC FB1E FC5E-FC63 FCF2-FCF4 FE00-FE0F FE20-FE2F FE70-FE74 FE76-FE7F FEFF "
        "FF9E-FF9F FFF9-FFFB 101FD 102E0 10A0D-10A0F 10A38-10A3A 10AE5-10AE6 "
        "10D24-10D27 10D6A-10D6D 10EAB-10EAC 10EFC-10EFF 10F46-10F50 10F82-10F85 "
        "11000-11002 11080-11082 110BA 110BD 110CD 11100-11102 11173 11180-11182 "
        "111C9-111CC 111CF 11234 11236-11237 1123E 112DF 112E9 11300-11303 1133B-1133C "
        "11366-1136C 11370-11374 113CA 113CC-113CD 113D2 113E1-113E2 11443-11446 1145E "
        "114BF-114C1 114C3 115BC-115BE 115C0 1163D-1163E 11640 116AB-116AC 116B7 "
        "11837-11838 1183A 1193B-1193C 11943 119DE-119DF 11A33 11A35-11A39 11A96-11A98 "
        "11C3C-11C3E 11CB5-11CB6 11D40-11D43 11D95-11D96 11F00-11F01 11F03 11F5A "
        "13430-13440 13447-13455 1612D 16AF0-16AF4 16B30-16B36 16FE4 16FF0-16FF1 "
        "1BC9D-1BC9E 1BCA0-1BCA3 1CF00-1CF2D 1CF30-1CF46 1D165-1D169 1D16D-1D182 "
        "1D185-1D18B 1D1AA-1D1AD 1D242-1D244 1DA00-1DA36 1DA3B-1DA6C 1DA75 1DA84 "
        "1DA9B-1DA9F 1DAA1-1DAAF 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF 1E5EE-1E5EF "
        "1E8D0-1E8D6 1E944-1E94A E0001 E0020-E007F E0100-E01EF")

# Equal to the one character.
ONE = {
    " ": (
        "A0 1680 2000-200A 202F 205F 3000"),
    "!": (
        "FE15 FE57 FF01"),
    "\"": (
        "5F4 201C-201F 2E42 301D-301F FF02"),
    "#": (
        "FE5F FF03"),
    "$": (
        "FE69 FF04"),
    "%": (
        "FE6A FF05"),
    "&": (
        "FE60 FF06"),
    "'": (
        "5F3 2018-201B FF07"),
    "(": (
        "207D 208D FE35 FE59 FF08"),
    ")": (
        "207E 208E FE36 FE5A FF09"),
    "*": (
        "FE61 FF0A"),
    "+": (
        "207A 208A FB29 FE62 FF0B"),
    ",": (
        "FE10 FE50 FF0C"),
    "-": (
        "FE63 FF0D"),
    ".": (
        "2024 FE52 FF0E"),
    "/": (
        "FF0F"),
    "0": (
        "660 6F0 7C0 966 9E6 A66 AE6 B66 BE6 C66 C78 CE6 D66 DE6 E50 ED0 F20 F33 1040 "
        "1090 17E0 17F0 1810 1946 19D0 1A80 1A90 1B50 1BB0 1C40 1C50 2070 2080 24EA "
        "24FF 3007 A620 A8D0 A900 A9D0 A9F0 AA50 ABF0 FF10 1018A 104A0 10D30 10D40 "
        "11066 110F0 11136 111D0 112F0 11450 114D0 11650 116C0 116D0 116DA 11730 118E0 "
        "11950 11BF0 11C50 11D50 11DA0 11F50 16130 16A60 16AC0 16B50 16D70 16E80 1CCF0 "
        "1D2C0 1D2E0 1D7CE 1D7D8 1D7E2 1D7EC 1D7F6 1E140 1E2F0 1E4F0 1E5F1 1E950 "
        "1F10B-1F10C 1FBF0"),
    "1": (
        "B9 661 6F1 7C1 967 9E7 A67 AE7 B67 BE7 C67 C79 C7C CE7 D67 DE7 E51 ED1 F21 "
        "F2A 1041 1091 1369 17E1 17F1 1811 1947 19D1 19DA 1A81 1A91 1B51 1BB1 1C41 "
        "1C51 2081 2460 24F5 2776 2780 278A 3021 A621 A8D1 A901 A9D1 A9F1 AA51 ABF1 "
        "FF11 10107 10142 10158-1015A 102E1 10320 103D1 104A1 10858 10879 108A7 108FB "
        "10916 109C0 10A40 10A7D 10A9D 10AEB 10B58 10B78 10BA9 10CFA 10D31 10D41 10E60 "
        "10F1D 10F51 10FC5 11052 11067 110F1 11137 111D1 111E1 112F1 11451 114D1 11651 "
        "116C1 116D1 116DB 11731 118E1 11951 11BF1 11C51 11C5A 11D51 11DA1 11F51 12415 "
        "1241E 1242C 12434 1244F 12458 16131 16A61 16AC1 16B51 16D71 16E81 16E94 1CCF1 "
        "1D2C1 1D2E1 1D360 1D372 1D377 1D7CF 1D7D9 1D7E3 1D7ED 1D7F7 1E141 1E2F1 1E4F1 "
        "1E5F2 1E8C7 1E951 1EC71 1ECA3 1ECB1 1ED01 1FBF1"),
    "2": (
        "B2 662 6F2 7C2 968 9E8 A68 AE8 B68 BE8 C68 C7A C7D CE8 D68 DE8 E52 ED2 F22 "
        "F2B 1042 1092 136A 17E2 17F2 1812 1948 19D2 1A82 1A92 1B52 1BB2 1C42 1C52 "
        "2082 2461 24F6 2777 2781 278B 3022 A622 A8D2 A902 A9D2 A9F2 AA52 ABF2 FF12 "
        "10108 1015B-1015E 102E2 103D2 104A2 10859 1087A 108A8 1091A 109C1 10A41 10B59 "
        "10B79 10BAA 10D32 10D42 10E61 10F1E 10FC6 11053 11068 110F2 11138 111D2 111E2 "
        "112F2 11452 114D2 11652 116C2 116D2 116DC 11732 118E2 11952 11BF2 11C52 11C5B "
        "11D52 11DA2 11F52 12400 12416 1241F 12423 1242D 12435 1244A 12450 12456 12459 "
        "16132 16A62 16AC2 16B52 16D72 16E82 16E95 1CCF2 1D2C2 1D2E2 1D361 1D373 1D7D0 "
        "1D7DA 1D7E4 1D7EE 1D7F8 1E142 1E2F2 1E4F2 1E5F3 1E8C8 1E952 1EC72 1ECA4 1ECB2 "
        "1ED02 1ED2F 1FBF2"),
    "3": (
        "B3 663 6F3 7C3 969 9E9 A69 AE9 B69 BE9 C69 C7B C7E CE9 D69 DE9 E53 ED3 F23 "
        "F2C 1043 1093 136B 17E3 17F3 1813 1949 19D3 1A83 1A93 1B53 1BB3 1C43 1C53 "
        "2083 2462 24F7 2778 2782 278C 3023 A623 A8D3 A903 A9D3 A9F3 AA53 ABF3 FF13 "
        "10109 102E3 104A3 1085A 1087B 108A9 1091B 109C2 10A42 10B5A 10B7A 10BAB 10D33 "
        "10D43 10E62 10F1F 10FC7 11054 11069 110F3 11139 111D3 111E3 112F3 11453 114D3 "
        "11653 116C3 116D3 116DD 11733 118E3 11953 11BF3 11C53 11C5C 11D53 11DA3 11F53 "
        "12401 12408 12417 12420 12424-12425 1242E-1242F 12436-12437 1243A-1243B 1244B "
        "12451 12457 16133 16A63 16AC3 16B53 16D73 16E83 16E96 1CCF3 1D2C3 1D2E3 1D362 "
        "1D374 1D7D1 1D7DB 1D7E5 1D7EF 1D7F9 1E143 1E2F3 1E4F3 1E5F4 1E8C9 1E953 1EC73 "
        "1ECA5 1ED03 1ED30 1FBF3"),
    "4": (
        "664 6F4 7C4 96A 9EA A6A AEA B6A BEA C6A CEA D6A DEA E54 ED4 F24 F2D 1044 1094 "
        "136C 17E4 17F4 1814 194A 19D4 1A84 1A94 1B54 1BB4 1C44 1C54 2074 2084 2463 "
        "24F8 2779 2783 278D 3024 A624 A8D4 A904 A9D4 A9F4 AA54 ABF4 FF14 1010A 102E4 "
        "104A4 1087C 108AA-108AB 109C3 10A43 10B5B 10B7B 10BAC 10D34 10D44 10E63 10F20 "
        "10FC8 11055 1106A 110F4 1113A 111D4 111E4 112F4 11454 114D4 11654 116C4 116D4 "
        "116DE 11734 118E4 11954 11BF4 11C54 11C5D 11D54 11DA4 11F54 12402 12409 1240F "
        "12418 12421 12426 12430 12438 1243C-1243F 1244C 12452-12453 12469 16134 16A64 "
        "16AC4 16B54 16D74 16E84 1CCF4 1D2C4 1D2E4 1D363 1D375 1D7D2 1D7DC 1D7E6 1D7F0 "
        "1D7FA 1E144 1E2F4 1E4F4 1E5F5 1E8CA 1E954 1EC74 1ECA6 1ED04 1ED31 1FBF4"),
    "5": (
        "665 6F5 7C5 96B 9EB A6B AEB B6B BEB C6B CEB D6B DEB E55 ED5 F25 F2E 1045 1095 "
        "136D 17E5 17F5 1815 194B 19D5 1A85 1A95 1B55 1BB5 1C45 1C55 2075 2085 2464 "
        "24F9 277A 2784 278E 3025 A625 A8D5 A905 A9D5 A9F5 AA55 ABF5 FF15 1010B 10143 "
        "10148 1014F 1015F 10173 102E5 10321 104A5 1087D 108AC 108FC 109C4 10AEC 10CFB "
        "10D35 10D45 10E64 10F21 11056 1106B 110F5 1113B 111D5 111E5 112F5 11455 114D5 "
        "11655 116C5 116D5 116DF 11735 118E5 11955 11BF5 11C55 11C5E 11D55 11DA5 11F55 "
        "12403 1240A 12410 12419 12422 12427 12431 12439 1244D 12454-12455 1246A 16135 "
        "16A65 16AC5 16B55 16D75 16E85 1CCF5 1D2C5 1D2E5 1D364 1D376 1D378 1D7D3 1D7DD "
        "1D7E7 1D7F1 1D7FB 1E145 1E2F5 1E4F5 1E5F6 1E8CB 1E955 1EC75 1ECA7 1ED05 1ED32 "
        "1FBF5"),
    "6": (
        "666 6F6 7C6 96C 9EC A6C AEC B6C BEC C6C CEC D6C DEC E56 ED6 F26 F2F 1046 1096 "
        "136E 17E6 17F6 1816 194C 19D6 1A86 1A96 1B56 1BB6 1C46 1C56 2076 2086 2185 "
        "2465 24FA 277B 2785 278F 3026 A626 A8D6 A906 A9D6 A9F6 AA56 ABF6 FF16 1010C "
        "102E6 104A6 109C5 10D36 10D46 10E65 11057 1106C 110F6 1113C 111D6 111E6 112F6 "
        "11456 114D6 11656 116C6 116D6 116E0 11736 118E6 11956 11BF6 11C56 11C5F 11D56 "
        "11DA6 11F56 12404 1240B 12411 1241A 12428 12440 1244E 1246B 16136 16A66 16AC6 "
        "16B56 16D76 16E86 1CCF6 1D2C6 1D2E6 1D365 1D7D4 1D7DE 1D7E8 1D7F2 1D7FC 1E146 "
        "1E2F6 1E4F6 1E5F7 1E8CC 1E956 1EC76 1ECA8 1ED06 1ED33 1FBF6"),
    "7": (
        "667 6F7 7C7 96D 9ED A6D AED B6D BED C6D CED D6D DED E57 ED7 F27 F30 1047 1097 "
        "136F 17E7 17F7 1817 194D 19D7 1A87 1A97 1B57 1BB7 1C47 1C57 2077 2087 2466 "
        "24FB 277C 2786 2790 3027 A627 A8D7 A907 A9D7 A9F7 AA57 ABF7 FF17 1010D 102E7 "
        "104A7 109C6 10D37 10D47 10E66 11058 1106D 110F7 1113D 111D7 111E7 112F7 11457 "
        "114D7 11657 116C7 116D7 116E1 11737 118E7 11957 11BF7 11C57 11C60 11D57 11DA7 "
        "11F57 12405 1240C 12412 1241B 12429 12441-12443 1246C 16137 16A67 16AC7 16B57 "
        "16D77 16E87 1CCF7 1D2C7 1D2E7 1D366 1D7D5 1D7DF 1D7E9 1D7F3 1D7FD 1E147 1E2F7 "
        "1E4F7 1E5F8 1E8CD 1E957 1EC77 1ECA9 1ED07 1ED34 1FBF7"),
    "8": (
        "668 6F8 7C8 96E 9EE A6E AEE B6E BEE C6E CEE D6E DEE E58 ED8 F28 F31 1048 1098 "
        "1370 17E8 17F8 1818 194E 19D8 1A88 1A98 1B58 1BB8 1C48 1C58 2078 2088 2467 "
        "24FC 277D 2787 2791 3028 A628 A8D8 A908 A9D8 A9F8 AA58 ABF8 FF18 1010E 102E8 "
        "104A8 109C7 10D38 10D48 10E67 11059 1106E 110F8 1113E 111D8 111E8 112F8 11458 "
        "114D8 11658 116C8 116D8 116E2 11738 118E8 11958 11BF8 11C58 11C61 11D58 11DA8 "
        "11F58 12406 1240D 12413 1241C 1242A 12444-12445 1246D 16138 16A68 16AC8 16B58 "
        "16D78 16E88 1CCF8 1D2C8 1D2E8 1D367 1D7D6 1D7E0 1D7EA 1D7F4 1D7FE 1E148 1E2F8 "
        "1E4F8 1E5F9 1E8CE 1E958 1EC78 1ECAA 1ED08 1ED35 1FBF8"),
    "9": (
        "669 6F9 7C9 96F 9EF A6F AEF B6F BEF C6F CEF D6F DEF E59 ED9 F29 F32 1049 1099 "
        "1371 17E9 17F9 1819 194F 19D9 1A89 1A99 1B59 1BB9 1C49 1C59 2079 2089 2468 "
        "24FD 277E 2788 2792 3029 A629 A8D9 A909 A9D9 A9F9 AA59 ABF9 FF19 1010F 102E9 "
        "104A9 109C8 10D39 10D49 10E68 1105A 1106F 110F9 1113F 111D9 111E9 112F9 11459 "
        "114D9 11659 116C9 116D9 116E3 11739 118E9 11959 11BF9 11C59 11C62 11D59 11DA9 "
        "11F59 12407 1240E 12414 1241D 1242B 12446-12449 1246E 16139 16A69 16AC9 16B59 "
        "16D79 16E89 1CCF9 1D2C9 1D2E9 1D368 1D7D7 1D7E1 1D7EB 1D7F5 1D7FF 1E149 1E2F9 "
        "1E4F9 1E5FA 1E8CF 1E959 1EC79 1ECAB 1ED09 1ED36 1FBF9"),
    ":": (
        "FE13 FE55 FF1A"),
    ";": (
        "37E FE14 FE54 FF1B"),
    "<": (
        "226E FE64 FF1C"),
    "=": (
        "207C 208C 2260 FE66 FF1D"),
    ">": (
        "226F FE65 FF1E"),
    "?": (
        "FE16 FE56 FF1F"),
    "@": (
        "FE6B FF20"),
    "[": (
        "FE47 FF3B"),
    "\\": (
        "FE68 FF3C"),
    "]": (
        "FE48 FF3D"),
    "^": (
        "FF3E"),
    "_": (
        "FE33-FE34 FE4D-FE4F FF3F"),
    "`": (
        "1FEF FF40"),
    "a": (
        "AA C0-C5 E0-E5 100-105 1CD-1CE 1DE-1E1 1FA-1FB 200-203 226-227 363 1D2C 1D43 "
        "1DD3 1DF2 1E00-1E01 1EA0-1EB7 2090 212B 24B6 24D0 A79A-A79B A7C0-A7C1 FF21 "
        "FF41 1CCD6 1D400 1D41A 1D434 1D44E 1D468 1D482 1D49C 1D4B6 1D4D0 1D4EA 1D504 "
        "1D51E 1D538 1D552 1D56C 1D586 1D5A0 1D5BA 1D5D4 1D5EE 1D608 1D622 1D63C 1D656 "
        "1D670 1D68A 1F130 1F150 1F170"),
    "b": (
        "1D2E 1D47 1DE8 1E02-1E07 212C 24B7 24D1 FF22 FF42 1CCD7 1D401 1D41B 1D435 "
        "1D44F 1D469 1D483 1D4B7 1D4D1 1D4EB 1D505 1D51F 1D539 1D553 1D56D 1D587 1D5A1 "
        "1D5BB 1D5D5 1D5EF 1D609 1D623 1D63D 1D657 1D671 1D68B 1F131 1F151 1F171"),
    "c": (
        "C7 E7 106-10D 368 1D9C 1DD7 1E08-1E09 2102 212D 216D 217D 24B8 24D2 A7F2 FF23 "
        "FF43 1CCD8 1D402 1D41C 1D436 1D450 1D46A 1D484 1D49E 1D4B8 1D4D2 1D4EC 1D520 "
        "1D554 1D56E 1D588 1D5A2 1D5BC 1D5D6 1D5F0 1D60A 1D624 1D63E 1D658 1D672 1D68C "
        "1F12B 1F132 1F152 1F172"),
    "d": (
        "D0 F0 10E-111 369 1D30 1D48 1D9E 1DD8-1DD9 1E0A-1E13 2145-2146 216E 217E 24B9 "
        "24D3 A779-A77A FF24 FF44 1CCD9 1D403 1D41D 1D437 1D451 1D46B 1D485 1D49F "
        "1D4B9 1D4D3 1D4ED 1D507 1D521 1D53B 1D555 1D56F 1D589 1D5A3 1D5BD 1D5D7 1D5F1 "
        "1D60B 1D625 1D63F 1D659 1D673 1D68D 1F133 1F153 1F173 1F1A5"),
    "e": (
        "C8-CB E8-EB 112-11B 204-207 228-229 364 1D31 1D49 1E14-1E1D 1EB8-1EC7 2091 "
        "212F-2130 2147 24BA 24D4 FF25 FF45 1CCDA 1D404 1D41E 1D438 1D452 1D46C 1D486 "
        "1D4D4 1D4EE 1D508 1D522 1D53C 1D556 1D570 1D58A 1D5A4 1D5BE 1D5D8 1D5F2 1D60C "
        "1D626 1D640 1D65A 1D674 1D68E 1F134 1F154 1F174"),
    "f": (
        "1DA0 1DEB 1E1E-1E1F 2131 24BB 24D5 A77B-A77C A7F3 FF26 FF46 1CCDB 1D405 1D41F "
        "1D439 1D453 1D46D 1D487 1D4BB 1D4D5 1D4EF 1D509 1D523 1D53D 1D557 1D571 1D58B "
        "1D5A5 1D5BF 1D5D9 1D5F3 1D60D 1D627 1D641 1D65B 1D675 1D68F 1F135 1F155 1F175"),
    "g": (
        "11C-123 1E6-1E7 1F4-1F5 1ACC 1D33 1D4D 1D79 1DDA 1E20-1E21 210A 24BC 24D6 "
        "A77D A7A0-A7A1 FF27 FF47 1CCDC 1D406 1D420 1D43A 1D454 1D46E 1D488 1D4A2 "
        "1D4D6 1D4F0 1D50A 1D524 1D53E 1D558 1D572 1D58C 1D5A6 1D5C0 1D5DA 1D5F4 1D60E "
        "1D628 1D642 1D65C 1D676 1D690 1F136 1F156 1F176"),
    "h": (
        "124-127 21E-21F 2B0 36A 1D34 1E22-1E2B 1E96 2095 210B-210F 24BD 24D7 A7F8 "
        "FF28 FF48 10795 1CCDD 1D407 1D421 1D43B 1D46F 1D489 1D4BD 1D4D7 1D4F1 1D525 "
        "1D559 1D573 1D58D 1D5A7 1D5C1 1D5DB 1D5F5 1D60F 1D629 1D643 1D65D 1D677 1D691 "
        "1F137 1F157 1F177"),
    "i": (
        "CC-CF EC-EF 128-130 1CF-1D0 208-20B 365 1D35 1D62 1E2C-1E2F 1EC8-1ECB 2071 "
        "2110-2111 2139 2148 2160 2170 24BE 24D8 FF29 FF49 1CCDE 1D408 1D422 1D43C "
        "1D456 1D470 1D48A 1D4BE 1D4D8 1D4F2 1D526 1D540 1D55A 1D574 1D58E 1D5A8 1D5C2 "
        "1D5DC 1D5F6 1D610 1D62A 1D644 1D65E 1D678 1D692 1F138 1F158 1F178"),
    "j": (
        "134-135 1F0 2B2 1D36 2149 24BF 24D9 2C7C FF2A FF4A 1CCDF 1D409 1D423 1D43D "
        "1D457 1D471 1D48B 1D4A5 1D4BF 1D4D9 1D4F3 1D50D 1D527 1D541 1D55B 1D575 1D58F "
        "1D5A9 1D5C3 1D5DD 1D5F7 1D611 1D62B 1D645 1D65F 1D679 1D693 1F139 1F159 1F179"),
    "k": (
        "136-137 1E8-1E9 1D37 1D4F 1DDC 1E30-1E35 2096 212A 24C0 24DA A7A2-A7A3 FF2B "
        "FF4B 1CCE0 1D40A 1D424 1D43E 1D458 1D472 1D48C 1D4A6 1D4C0 1D4DA 1D4F4 1D50E "
        "1D528 1D542 1D55C 1D576 1D590 1D5AA 1D5C4 1D5DE 1D5F8 1D612 1D62C 1D646 1D660 "
        "1D67A 1D694 1F13A 1F15A 1F17A"),
    "l": (
        "139-142 2E1 1D38 1DDD 1E36-1E3D 2097 2112-2113 216C 217C 24C1 24DB FF2C FF4C "
        "1CCE1 1D40B 1D425 1D43F 1D459 1D473 1D48D 1D4C1 1D4DB 1D4F5 1D50F 1D529 1D543 "
        "1D55D 1D577 1D591 1D5AB 1D5C5 1D5DF 1D5F9 1D613 1D62D 1D647 1D661 1D67B 1D695 "
        "1F13B 1F15B 1F17B"),
    "m": (
        "36B 1D39 1D50 1E3E-1E43 2098 2133 216F 217F 24C2 24DC FF2D FF4D 1CCE2 1D40C "
        "1D426 1D440 1D45A 1D474 1D48E 1D4C2 1D4DC 1D4F6 1D510 1D52A 1D544 1D55E 1D578 "
        "1D592 1D5AC 1D5C6 1D5E0 1D5FA 1D614 1D62E 1D648 1D662 1D67C 1D696 1F13C 1F15C "
        "1F17C"),
    "n": (
        "D1 F1 143-148 1F8-1F9 1D3A 1DE0 1E44-1E4B 207F 2099 2115 24C3 24DD A7A4-A7A5 "
        "FF2E FF4E 1CCE3 1D40D 1D427 1D441 1D45B 1D475 1D48F 1D4A9 1D4C3 1D4DD 1D4F7 "
        "1D511 1D52B 1D55F 1D579 1D593 1D5AD 1D5C7 1D5E1 1D5FB 1D615 1D62F 1D649 1D663 "
        "1D67D 1D697 1F13D 1F15D 1F17D"),
    "o": (
        "BA D2-D6 D8 F2-F6 F8 14C-151 1A0-1A1 1D1-1D2 1EA-1ED 1FE-1FF 20C-20F 22A-231 "
        "366 1D3C 1D52 1DED 1DF3 1E4C-1E53 1ECC-1EE3 2092 2134 24C4 24DE A79C-A79D "
        "FF2F FF4F 107A2 1CCE4 1D40E 1D428 1D442 1D45C 1D476 1D490 1D4AA 1D4DE 1D4F8 "
        "1D512 1D52C 1D546 1D560 1D57A 1D594 1D5AE 1D5C8 1D5E2 1D5FC 1D616 1D630 1D64A "
        "1D664 1D67E 1D698 1F13E 1F15E 1F17E"),
    "p": (
        "1D3E 1D56 1DEE 1E54-1E57 209A 2119 24C5 24DF FF30 FF50 1CCE5 1D40F 1D429 "
        "1D443 1D45D 1D477 1D491 1D4AB 1D4C5 1D4DF 1D4F9 1D513 1D52D 1D561 1D57B 1D595 "
        "1D5AF 1D5C9 1D5E3 1D5FD 1D617 1D631 1D64B 1D665 1D67F 1D699 1F13F 1F15F 1F17F "
        "1F18A"),
    "q": (
        "211A 24C6 24E0 A7F4 FF31 FF51 107A5 1CCE6 1D410 1D42A 1D444 1D45E 1D478 1D492 "
        "1D4AC 1D4C6 1D4E0 1D4FA 1D514 1D52E 1D562 1D57C 1D596 1D5B0 1D5CA 1D5E4 1D5FE "
        "1D618 1D632 1D64C 1D666 1D680 1D69A 1F140 1F160 1F180"),
    "r": (
        "154-159 210-213 2B3 36C 1ACD 1D3F 1D63 1DCA 1DE3 1E58-1E5F 211B-211D 24C7 "
        "24E1 A75A-A75B A782-A783 A7A6-A7A7 FF32 FF52 1CCE7 1D411 1D42B 1D445 1D45F "
        "1D479 1D493 1D4C7 1D4E1 1D4FB 1D52F 1D563 1D57D 1D597 1D5B1 1D5CB 1D5E5 1D5FF "
        "1D619 1D633 1D64D 1D667 1D681 1D69B 1F12C 1F141 1F161 1F181"),
    "s": (
        "15A-161 17F 218-219 2E2 1DE4-1DE5 1E60-1E69 1E9B 209B 24C8 24E2 A784-A785 "
        "A7A8-A7A9 A7D8-A7D9 FF33 FF53 1CCE8 1D412 1D42C 1D446 1D460 1D47A 1D494 1D4AE "
        "1D4C8 1D4E2 1D4FC 1D516 1D530 1D54A 1D564 1D57E 1D598 1D5B2 1D5CC 1D5E6 1D600 "
        "1D61A 1D634 1D64E 1D668 1D682 1D69C 1F142 1F162 1F182"),
    "t": (
        "162-165 21A-21B 36D 1ACE 1D40 1D57 1E6A-1E71 1E97 209C 24C9 24E3 A786-A787 "
        "FF34 FF54 1CCE9 1D413 1D42D 1D447 1D461 1D47B 1D495 1D4AF 1D4C9 1D4E3 1D4FD "
        "1D517 1D531 1D54B 1D565 1D57F 1D599 1D5B3 1D5CD 1D5E7 1D601 1D61B 1D635 1D64F "
        "1D669 1D683 1D69D 1F143 1F163 1F183"),
    "u": (
        "D9-DC F9-FC 168-173 1AF-1B0 1D3-1DC 214-217 367 1D41 1D58 1D64 1DF0 1DF4 "
        "1E72-1E7B 1EE4-1EF1 24CA 24E4 A79E-A79F FF35 FF55 1CCEA 1D414 1D42E 1D448 "
        "1D462 1D47C 1D496 1D4B0 1D4CA 1D4E4 1D4FE 1D518 1D532 1D54C 1D566 1D580 1D59A "
        "1D5B4 1D5CE 1D5E8 1D602 1D61C 1D636 1D650 1D66A 1D684 1D69E 1F144 1F164 1F184"),
    "v": (
        "36E 1D5B 1D65 1E7C-1E7F 2164 2174 24CB 24E5 2C7D FF36 FF56 1CCEB 1D415 1D42F "
        "1D449 1D463 1D47D 1D497 1D4B1 1D4CB 1D4E5 1D4FF 1D519 1D533 1D54D 1D567 1D581 "
        "1D59B 1D5B5 1D5CF 1D5E9 1D603 1D61D 1D637 1D651 1D66B 1D685 1D69F 1F145 1F165 "
        "1F185"),
    "w": (
        "174-175 2B7 1ABF 1D42 1DF1 1E80-1E89 1E98 24CC 24E6 A7C2-A7C3 FF37 FF57 1CCEC "
        "1D416 1D430 1D44A 1D464 1D47E 1D498 1D4B2 1D4CC 1D4E6 1D500 1D51A 1D534 1D54E "
        "1D568 1D582 1D59C 1D5B6 1D5D0 1D5EA 1D604 1D61E 1D638 1D652 1D66C 1D686 1D6A0 "
        "1F146 1F166 1F186"),
    "x": (
        "2E3 36F 1E8A-1E8D 2093 2169 2179 24CD 24E7 FF38 FF58 1CCED 1D417 1D431 1D44B "
        "1D465 1D47F 1D499 1D4B3 1D4CD 1D4E7 1D501 1D51B 1D535 1D54F 1D569 1D583 1D59D "
        "1D5B7 1D5D1 1D5EB 1D605 1D61F 1D639 1D653 1D66D 1D687 1D6A1 1F147 1F167 1F187"),
    "y": (
        "DD FD FF 176-178 232-233 2B8 1E8E-1E8F 1E99 1EF2-1EF9 24CE 24E8 FF39 FF59 "
        "1CCEE 1D418 1D432 1D44C 1D466 1D480 1D49A 1D4B4 1D4CE 1D4E8 1D502 1D51C 1D536 "
        "1D550 1D56A 1D584 1D59E 1D5B8 1D5D2 1D5EC 1D606 1D620 1D63A 1D654 1D66E 1D688 "
        "1D6A2 1F148 1F168 1F188"),
    "z": (
        "179-17E 1DBB 1DE6 1E90-1E95 2124 2128 24CF 24E9 FF3A FF5A 1CCEF 1D419 1D433 "
        "1D44D 1D467 1D481 1D49B 1D4B5 1D4CF 1D4E9 1D503 1D537 1D56B 1D585 1D59F 1D5B9 "
        "1D5D3 1D5ED 1D607 1D621 1D63B 1D655 1D66F 1D689 1D6A3 1F149 1F169 1F189"),
    "{": (
        "FE37 FE5B FF5B"),
    "|": (
        "FF5C"),
    "}": (
        "FE38 FE5C FF5D"),
    "~": (
        "FF5E"),
}

# Equal to the text.
SEVERAL = {
    "!!": "203C",
    "!?": "2049",
    "(1)": "2474",
    "(10)": "247D",
    "(11)": "247E",
    "(12)": "247F",
    "(13)": "2480",
    "(14)": "2481",
    "(15)": "2482",
    "(16)": "2483",
    "(17)": "2484",
    "(18)": "2485",
    "(19)": "2486",
    "(2)": "2475",
    "(20)": "2487",
    "(3)": "2476",
    "(4)": "2477",
    "(5)": "2478",
    "(6)": "2479",
    "(7)": "247A",
    "(8)": "247B",
    "(9)": "247C",
    "(a)": "249C 1F110",
    "(b)": "249D 1F111",
    "(c)": "249E 1F112",
    "(d)": "249F 1F113",
    "(e)": "24A0 1F114",
    "(f)": "24A1 1F115",
    "(g)": "24A2 1F116",
    "(h)": "24A3 1F117",
    "(i)": "24A4 1F118",
    "(j)": "24A5 1F119",
    "(k)": "24A6 1F11A",
    "(l)": "24A7 1F11B",
    "(m)": "24A8 1F11C",
    "(n)": "24A9 1F11D",
    "(o)": "24AA 1F11E",
    "(p)": "24AB 1F11F",
    "(q)": "24AC 1F120",
    "(r)": "24AD 1F121",
    "(s)": "24AE 1F122",
    "(t)": "24AF 1F123",
    "(u)": "24B0 1F124",
    "(v)": "24B1 1F125",
    "(w)": "24B2 1F126",
    "(x)": "24B3 1F127",
    "(y)": "24B4 1F128",
    "(z)": "24B5 1F129",
    "..": "2025 FE30",
    "...": "2026 FE19",
    "0,": "1F101",
    "0.": "1F100",
    "1,": "1F102",
    "1.": "2488",
    "10": "2469 24FE 277F 2789 2793 3248",
    "10.": "2491",
    "11": "246A 24EB",
    "11.": "2492",
    "12": "246B 24EC",
    "12.": "2493",
    "120p": "1F1A4",
    "13": "246C 24ED",
    "13.": "2494",
    "14": "246D 24EE",
    "14.": "2495",
    "15": "246E 24EF",
    "15.": "2496",
    "16": "246F 24F0",
    "16.": "2497",
    "17": "2470 24F1",
    "17.": "2498",
    "18": "2471 24F2",
    "18.": "2499",
    "19": "2472 24F3",
    "19.": "249A",
    "2,": "1F103",
    "2.": "2489",
    "20": "2473 24F4 3249",
    "20.": "249B",
    "21": "3251",
    "22": "3252",
    "22.2": "1F1A2",
    "23": "3253",
    "24": "3254",
    "25": "3255",
    "26": "3256",
    "27": "3257",
    "28": "3258",
    "29": "3259",
    "2k": "1F19D",
    "2nd scr": "1F19C",
    "3,": "1F104",
    "3.": "248A",
    "30": "324A 325A",
    "31": "325B",
    "32": "325C",
    "33": "325D",
    "34": "325E",
    "35": "325F",
    "36": "32B1",
    "37": "32B2",
    "38": "32B3",
    "39": "32B4",
    "3d": "1F19B",
    "4,": "1F105",
    "4.": "248B",
    "40": "324B 32B5",
    "41": "32B6",
    "42": "32B7",
    "43": "32B8",
    "44": "32B9",
    "45": "32BA",
    "46": "32BB",
    "47": "32BC",
    "48": "32BD",
    "49": "32BE",
    "4k": "1F19E",
    "5,": "1F106",
    "5.": "248C",
    "5.1": "1F1A0",
    "50": "324C 32BF",
    "6,": "1F107",
    "6.": "248D",
    "60": "324D",
    "60p": "1F1A3",
    "7,": "1F108",
    "7.": "248E",
    "7.1": "1F1A1",
    "70": "324E",
    "8,": "1F109",
    "8.": "248F",
    "80": "324F",
    "8k": "1F19F",
    "9,": "1F10A",
    "9.": "2490",
    "::=": "2A74",
    "==": "2A75",
    "===": "2A76",
    "?!": "2048",
    "??": "2047",
    "a.m.": "33C2",
    "a/c": "2100",
    "a/s": "2101 214D",
    "aa": "A732-A733 10780",
    "ab": "1F18E",
    "ae": "C6 E6 1E2-1E3 1FC-1FD 1D2D 1DD4 10783",
    "ao": "1DD5 A734-A735",
    "au": "3373 A736-A737",
    "av": "1DD6 A738-A73B",
    "ay": "A73C-A73D",
    "bar": "3374",
    "bq": "33C3",
    "c/o": "2105",
    "c/u": "2106",
    "cal": "3388",
    "cc": "33C4",
    "cd": "33C5 1F12D",
    "cl": "1F191",
    "cm": "339D",
    "cm2": "33A0",
    "cm3": "33A4",
    "co.": "33C7",
    "cool": "1F192",
    "da": "3372",
    "db": "238 33C8",
    "dj": "1F190",
    "dl": "3397",
    "dm": "3377",
    "dm2": "3378",
    "dm3": "3379",
    "dz": "1C4-1C6 1F1-1F3 2A3 10787",
    "erg": "32CD",
    "ev": "32CE",
    "fax": "213B",
    "ff": "FB00",
    "ffi": "FB03",
    "ffl": "FB04",
    "fi": "FB01",
    "fl": "FB02",
    "fm": "3399",
    "free": "1F193",
    "gal": "33FF",
    "gb": "3387",
    "ghz": "3393",
    "gpa": "33AC",
    "gy": "33C9",
    "ha": "33CA",
    "hc": "1F1A6",
    "hdr": "1F1A7",
    "hg": "32CC",
    "hi res": "1F1A8",
    "hp": "33CB",
    "hpa": "3371",
    "hv": "1F14A",
    "hz": "3390",
    "ic": "1F18B",
    "id": "1F194",
    "ii": "2161 2171",
    "iii": "2162 2172",
    "ij": "132-133",
    "in": "33CC",
    "iu": "337A",
    "iv": "2163 2173",
    "ix": "2168 2178",
    "ka": "3384",
    "kb": "3385",
    "kcal": "3389",
    "kg": "338F",
    "khz": "3391",
    "kk": "33CD",
    "kl": "3398",
    "km": "339E 33CE",
    "km2": "33A2",
    "km3": "33A6",
    "kpa": "33AA",
    "kt": "33CF",
    "kv": "33B8",
    "kw": "33BE",
    "lj": "1C7-1C9",
    "ll": "1EFA-1EFB",
    "lm": "33D0",
    "ln": "33D1",
    "log": "33D2",
    "lossless": "1F1A9",
    "ls": "2AA 10799",
    "ltd": "32CF",
    "lx": "33D3",
    "lz": "2AB 1079A",
    "m2": "33A1",
    "m3": "33A5",
    "ma": "3383",
    "mb": "3386 33D4",
    "mc": "1F16A",
    "md": "1F16B",
    "mg": "338E",
    "mhz": "3392",
    "mil": "33D5",
    "ml": "3396",
    "mm": "339C",
    "mm2": "339F",
    "mm3": "33A3",
    "mol": "33D6",
    "mpa": "33AB",
    "mr": "1F16C",
    "ms": "33B3",
    "mv": "33B7 33B9 1F14B",
    "mw": "33BD 33BF",
    "na": "3381",
    "new": "1F195",
    "nf": "338B",
    "ng": "1F196",
    "nj": "1CA-1CC",
    "nm": "339A",
    "no": "2116",
    "ns": "33B1",
    "nv": "33B5",
    "nw": "33BB",
    "oe": "152-153 A7F9",
    "ok": "1F197",
    "oo": "A74E-A74F",
    "ov": "3375",
    "p.m.": "33D8",
    "pa": "3380 33A9 1F18C",
    "pc": "3376",
    "pf": "338A",
    "ph": "33D7",
    "ppm": "33D9",
    "ppv": "1F14E",
    "pr": "33DA",
    "ps": "33B0",
    "pte": "3250",
    "pts": "20A7",
    "pv": "33B4",
    "pw": "33BA",
    "qp": "239",
    "rad": "33AD",
    "rs": "20A8",
    "sa": "1F18D",
    "sd": "1F14C",
    "shv": "1F1AA",
    "sm": "2120",
    "sos": "1F198",
    "sr": "33DB",
    "ss": "DF 1E9E 1F14D",
    "st": "FB05-FB06",
    "sv": "33DC",
    "tel": "2121",
    "th": "1D7A",
    "thz": "3394",
    "tm": "2122",
    "ts": "1BE 2A6 107AC",
    "tz": "A728-A729",
    "uhd": "1F1AB",
    "up!": "1F199",
    "vi": "2165 2175",
    "vii": "2166 2176",
    "viii": "2167 2177",
    "vod": "1F1AC",
    "vs": "1F19A",
    "vy": "A760-A761",
    "wb": "33DD",
    "wc": "1F14F 1F18F",
    "wz": "1F12E",
    "xi": "216A 217A",
    "xii": "216B 217B",
    "zw": "18D",
}
