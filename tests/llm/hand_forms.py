"""Personal data in forms written by hand, apart from the generator that labels the training windows: (kind, text, what is to be found)."""

FOUND = [
    # e-mail
    ("email", "You can write to anna dot meyer at posteo dot de until Friday.", "anna dot meyer at posteo dot de"),
    ("email", "Contact: jean.dupont [at] laposte [dot] net pour toute question.", "jean.dupont [at] laposte [dot] net"),
    ("email", "mail me (kim_lee(at)univ-lyon1.fr) before noon", "kim_lee(at)univ-lyon1.fr"),
    ("email", "Schreib an t.weber AT gmx DOT de, danke.", "t.weber AT gmx DOT de"),
    ("email", "Escribe a carmen.ruiz{at}correo{dot}es hoy.", "carmen.ruiz{at}correo{dot}es"),
    ("email", "ask info @ bakery-north.example about the order", "info @ bakery-north.example"),
    ("email", "The old list was ops(at)relay.example.org, now closed.", "ops(at)relay.example.org"),
    ("email", "Bitte an m.koch [at] firma-berlin.de senden.", "m.koch [at] firma-berlin.de"),
    # ip
    ("ip", "The server at 10[.]24[.]7[.]91 did not answer.", "10[.]24[.]7[.]91"),
    ("ip", "ping 192 . 168 . 4 . 17 twice", "192 . 168 . 4 . 17"),
    ("ip", "Der Rechner 172(.)16(.)0(.)5 ist aus.", "172(.)16(.)0(.)5"),
    ("ip", "blocked host 203 dot 0 dot 113 dot 9 at the gate", "203 dot 0 dot 113 dot 9"),
    ("ip", "depuis l'adresse 198[dot]51[dot]100[dot]23 hier", "198[dot]51[dot]100[dot]23"),
    # card
    ("card", "card 4539.1488.0343.6467 was refused", "4539.1488.0343.6467"),
    ("card", "Karte 5500/0000/0000/0004 gesperrt", "5500/0000/0000/0004"),
    ("card", "la tarjeta 4111_1111_1111_1111 no vale", "4111_1111_1111_1111"),
    ("card", "charged to 3400.000000.00009 in May", "3400.000000.00009"),
    ("card", "sa carte 6011 - 0000 - 0000 - 0004 est perdue", "6011 - 0000 - 0000 - 0004"),
    # phone
    ("phone", "Call me on (415) 555-2671 after six.", "(415) 555-2671"),
    ("phone", "Tel. 030 / 2093 1234, Montag bis Freitag", "030 / 2093 1234"),
    ("phone", "appelez le 01 44 27 44 27 demain", "01 44 27 44 27"),
    ("phone", "llámame al 912 34 56 78 por favor", "912 34 56 78"),
    ("phone", "ring 020 7946 0958 and ask for Sam", "020 7946 0958"),
    ("phone", "Telefon: 0049 89 636 48018", "0049 89 636 48018"),
    ("phone", "fax 415.555.0132 is still in use", "415.555.0132"),
    ("phone", "téléphone 06.12.34.56.78 le soir", "06.12.34.56.78"),
]

CLEAN = [
    "We met at noon and looked at the dots on the map for an hour.",
    "The ratio was 3.14159 in 1995 and 2.71828 in 2001, or 12 of 400 cases.",
    "Version 10.4.11 of the tool came before version 10.5.0 and 11.",
    "Paragraph 12.3.4 of the act, as amended on 12.03.2004, holds.",
    "Seite 100 bis 120, Band 4, Nummer 1999/2000, Auflage 12000.",
    "Le 14 juillet 1789, il y avait 7 prisonniers et 954 assaillants.",
    "El artículo 27 de 1978 y los 40 000 000 de habitantes.",
    "She is at home, he is at work; dot the letters and cross the others.",
    "ISBN 978-3-16-148410-0 was printed 5000 times.",
    "Order 2024-000123 for 15 items at 19.99 each, sum 299.85.",
    "The train leaves at 10:45 from track 3, the next at 11:15 and 11:45.",
    "population 1 234 567 890 in 2020, area 9 596 961 of 149 000 000",
]
