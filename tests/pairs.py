"""Pairs of names that must not match and that must, and a basket of 34 products with prices of three chains."""

BLOCK = [
    ("Naproxeno 250mg Tableta", "Naproxeno 550mg Tableta - Caja 100 UN"),
    ("Desloratadina 2.5mg/5ml Jarabe", "Desloratadina 2.5mg/10ml Jarabe - Frasco 60 ML"),
    ("Clorfenamina 2mg/5ml Jarabe Frasco 60 ML", "Clorfenamina 2mg/5ml Jarabe - Frasco 120 ML"),
    ("Paracetamol 500mg Tableta", "Paracetamol 500mg Solución oral - Frasco 120 ML"),
    ("Aeridin 10mg Tableta x 10", "Aeridin 10mg Tableta - Caja 30 UN"),
    ("Norprazole 20mg Cápsula de Liberación Retardada", "Dolocordralan Retard Comprimido de Liberación Retardada"),
    ("Bisolol 5mg Tableta", "Desloratadina 5mg Tableta - Caja 10 UN"),
    ("Findaler Jarabe Frasco 60 ML", "Ciruelax Jarabe - Frasco 60 ML"),
    ("Panadol Antigripal Tableta", "Panadol 500mg Tableta - Caja 100 UN"),
    ("Paracetamol 500mg Tableta", "Paracetamol 1g Tableta - Caja 100 UN"),
    ("Fulgrip Noche Gránulos para Solución Oral", "Ressfril Noches Gránulos Para Solución Oral - Sobre 1 UN"),
    ("Panadol 500mg Tableta", "Panadol Infantil 2+ años - Caja 100 UN"),
    ("Panadol 500mg Tableta", "Panadol 500 Mg Tableta Efervescente - Sobre 1 UN"),
    ("Maltofer 100mg/5ml Solución Bebible", "Maltofer Fol 100MG - Blister 10 UN"),
    ("Vitamina D Tableta - Frasco 60 UN", "Vitamina C Zinc Gomitas - Frasco 60 UN"),
    ("Supradyn Gragea - Caja 30 UN", "Supradyn Pronatal Comprimidos - Caja 30 UN"),
    ("Pediasure Vainilla Polvo - Lata 850 G", "Pediasure Peptigro Polvo Vainilla - Lata 850 G"),
    ("Vitamina C Tabletas - Frasco 30 UN", "Vitamina C Gomitas - Frasco 30 UN"),
]

MATCH = [
    ("Aeridin 10mg Tableta - Caja 30 UN", "Aeridin 10mg Tableta Caja 30 UN"),
    ("Clorfenamina Maleato 2mg/5ml Jarabe Frasco 120 ML", "Clorfenamina Maleato 2 Mg Jarabe - Frasco 120 ML"),
    ("Clorfenamina Maleato 2mg/5ml Jarabe Frasco 60 ML", "Clorfenamina Maleato 2 Mg Jarabe - Frasco 60 ML"),
    ("Desloratadina 2.5mg/5ml Jarabe Frasco 60 ML", "Desloratadina 2.5 Mg Jarabe - Frasco 60 ML"),
    ("Paracetamol 1g Tableta", "Paracetamol 1g Tableta - Caja 100 UN"),
    ("Supracalm 1G Comprimido - Caja 100 UN", "Supracalm 1 Gr Comprimido - Caja 100 UN"),
    ("Tapsin SC 1g Polvo efervescente", "Tapsin efervescente 1G sabor Limón - Caja 20 UN"),
    ("Panadol Niños 160mg/5ml Jarabe", "Panadol para Niños 2+ 160Mg Infantil Jarabe - Frasco 60 ML"),
    ("Efetamol 1G Gránulos Efervescentes", "Efetamol - Caja 20 UN"),
    ("Bonadol Cápsulas Blandas", "Bonadol Capsulas Blandas 500 G - Caja 100 UN"),
    ("Maltofer 100mg/5ml Solución Bebible", "Maltofer Bebible 5ML - Ampolla 1UN"),
    ("Farma D 5000UI Cápsula Blanda - Caja 30 UN", "Farma D 5000 UI Capsulas - Caja 30 UN"),
    ("Vitamina C 1000mg Tableta - Frasco 30 UN", "Vitamina C 1000 mg Tabletas - Frasco 30 UN"),
    ("Pediasure Vainilla Polvo - Lata 850 G", "Pediasure Vainilla en Polvo - Lata 850 G"),
]

#: categoria, producto, price and promotion of each chain (None: not sold), gap in percent
BASKET = [
    ("analgesico", "Paracetamol 500mg Tableta", ("10.00", False), ("10.00", False), ("10.00", False), 0.0),
    ("analgesico", "Ibuprofeno 400mg Tableta Recubierta", ("12.50", True), ("12.90", True), ("10.00", False), 29.0),
    ("analgesico", "Apronax 550mg Tableta Recubierta", ("7.20", False), ("7.60", False), ("7.60", False), 5.6),
    ("analgesico", "Dolocordralan 50mg Tableta", ("17.00", False), ("18.00", False), ("13.60", False), 32.4),
    ("antigripal", "Panadol Antigripal NF Tableta", ("2.50", False), ("2.60", False), ("2.70", False), 8.0),
    ("antigripal", "Nastizol Junior NF Antigripal", ("6.00", False), ("6.00", False), (None, None), 0.0),
    ("antigripal", "Bisolvon 8mg/5ml Jarabe Adultos", ("21.10", False), ("21.70", False), ("21.50", False), 2.8),
    ("alergia", "Loratadina 10mg Tableta", ("4.80", True), ("4.90", True), ("6.00", False), 25.0),
    ("alergia", "Clorfenamina Maleato 2mg/5ml Solución", ("2.20", False), ("2.30", False), (None, None), 4.5),
    ("gastro", "Sal de Andrews Polvo Efervescente", ("1.10", True), ("1.10", True), (None, None), 0.0),
    ("gastro", "Omeprazol 20mg Cápsula", ("11.20", True), ("11.50", True), ("13.00", False), 16.1),
    ("gastro", "Enterogermina Plus 4000 millones", ("8.62", False), ("8.88", False), (None, None), 3.0),
    ("vitaminas", "Redoxon Total Tableta Efervescente", ("43.80", True), ("43.80", True), ("43.80", False), 0.0),
    ("vitaminas", "Centrum Comprimido Recubierto", ("41.40", False), ("41.40", False), ("41.40", False), 0.0),
    ("vitaminas", "Supradyn Pronatal Comprimido", ("55.50", False), ("55.50", False), ("55.50", False), 0.0),
    ("nutricion", "Ensure Advance Vainilla (Frasco 220ml)", ("12.90", False), ("12.90", False), ("12.90", False), 0.0),
    ("nutricion", "Pediasure Vainilla (Lata 1.6kg)", ("176.90", True), ("176.90", True), ("178.90", False), 1.1),
    ("nutricion", "Magnesol Polvo Efervescente Naranja", ("30.90", True), ("30.90", True), ("33.50", False), 8.4),
    ("cuidado_personal", "Crema Dental Colgate Total Anti-sarro (150ml)", ("18.40", True), ("18.40", True), ("18.90", False), 2.7),
    ("cuidado_personal", "Shampoo Head & Shoulders Control Caspa (1L)", ("44.90", True), ("44.90", True), (None, None), 0.0),
    ("cuidado_personal", "Jabón Antibacterial Protex Omega 3 (Pack 3)", ("10.50", True), ("10.50", True), (None, None), 0.0),
    ("cuidado_personal", "Jabón Dove Cremoso Original (Pack 3)", ("10.90", True), ("10.90", True), ("11.90", True), 9.2),
    ("dermo", "Gel Limpiador Espumoso CeraVe (236ml)", ("50.60", True), ("50.60", True), ("69.90", True), 38.1),
    ("dermo", "Protector Solar Facial Eucerin Pigment", ("152.90", True), ("130.00", True), (None, None), 17.6),
    ("dermo", "Fotoprotector Isdin Fusion Fluid (50ml)", ("114.90", True), ("104.90", True), ("114.90", True), 9.5),
    ("dermo", "Barra Limpiadora Cetaphil Piel Sensible (127g)", ("68.50", False), ("56.50", True), ("69.90", False), 23.7),
    ("bebe", "Pañales Huggies Natural Care (Bolsa 60un)", ("42.90", True), ("42.90", True), ("42.90", True), 0.0),
    ("bebe", "Toalla Húmeda Babysec Super Premium", ("30.00", False), ("27.90", True), (None, None), 7.5),
    ("bebe", "Shampoo Johnson's Gotas de Brillo (750ml)", ("42.90", True), ("42.90", True), (None, None), 0.0),
    ("femenino", "Toallas Higiénicas Kotex Normal (60un)", ("12.90", True), ("12.90", True), ("16.10", False), 24.8),
    ("femenino", "Toallas Higiénicas Nosotras Invisible (40un)", ("18.50", True), ("18.50", True), (None, None), 0.0),
    ("primeros_auxilios", "Alcohol 70% (Frasco 1L)", ("10.10", False), ("10.40", False), ("9.90", False), 5.1),
    ("primeros_auxilios", "Agua Oxigenada Vol. 10 (1L)", ("4.70", True), ("4.80", True), ("5.00", False), 6.4),
    ("primeros_auxilios", "Curitas de Tela Elástica (Caja 8)", ("1.90", False), ("2.00", False), ("2.60", False), 36.8),
]
