"""Municipality to subregion mapping used by the authorisation report."""

# Upper-cased municipality names per subregion. Some names are cut
# short and only one carries an accented vowel; the data holds them that way.
SUBREGIONS = {
    "Valle de Aburrá": [
        "MEDELLÍN", "BELLO", "ENVIGADO", "ITAGUI", "SABANETA", "LA ESTRELLA",
        "CALDAS", "COPACABANA", "GIRARDOTA", "BARBOSA",
    ],
    "Oriente": [
        "RIONEGRO", "MARINILLA", "LA CEJA", "EL CARMEN DE VIBORAL", "EL RETIRO",
        "EL SANTUARIO", "GUARNE", "LA UNION", "SAN VICENTE FERRER",
        "ALEJANDRIA", "CONCEPCION", "EL PEÑOL", "GRANADA", "GUATAPE",
        "SAN CARLOS", "SAN RAFAEL", "COCORNA", "SAN FRANCISCO", "SAN LUIS",
        "ABEJORRAL", "ARGELIA", "NARIÑO", "SONSON",
    ],
    "Norte": [
        "SANTA ROSA DE OS", "SAN PEDRO DE LOS MILAGROS", "SAN JOSE DE LA MONTAÑA",
        "DONMATIAS", "ENTRERIOS", "BELMIRA", "CAROLINA DEL PRINCIPE",
        "GOMEZ PLATA", "GUADALUPE", "ANGOSTURA", "BRICEÑO", "CAMPAMENTO",
        "YARUMAL", "VALDIVIA", "ITUANGO", "SAN ANDRES DE CUERQUIA", "TOLEDO",
    ],
    "Nordeste": [
        "AMALFI", "ANORI", "CISNEROS", "REMEDIOS", "SEGOVIA", "SAN ROQUE",
        "SANTO DOMINGO", "VEGACHI", "YALI", "YOLOMBO",
    ],
    "Occidente": [
        "ANZA", "ARMENIA", "BURITICA", "CAICEDO", "EBEJICO", "GIRALDO",
        "HELICONIA", "LIBORINA", "OLAYA", "SABANALARGA", "SAN JERONIMO",
        "SANTAFE DE ANTIO", "SOPETRAN", "ABRIAQUI", "CANASGORDAS", "DABEIBA",
        "FRONTINO", "PEQUE", "URAMITA",
    ],
    "Suroeste": [
        "CARAMANTA", "JERICO", "LA PINTADA", "MONTEBELLO", "PUEBLORRICO",
        "SANTA BARBARA", "TAMESIS", "TARSO", "VALPARAISO", "BETULIA",
        "CONCORDIA", "SALGAR", "URRAO", "ANDES", "BETANIA", "CIUDAD BOLIVAR",
        "HISPANIA", "JARDIN", "AMAGA", "ANGELOPOLIS", "FREDONIA", "TITIRIBI",
        "VENECIA",
    ],
    "Bajo Cauca": ["CAUCASIA", "CACERES", "EL BAGRE", "NECHI", "TARAZA", "ZARAGOZA"],
    "Magdalena Medio": [
        "PUERTO BERRIO", "PUERTO NARE", "PUERTO TRIUNFO", "YONDO", "CARACOLI", "MACEO",
    ],
    "Urabá": [
        "APARTADO", "CAREPA", "CHIGORODO", "MUTATA", "TURBO", "ARBOLETES",
        "NECOCLI", "SAN JUAN DE URA", "SAN PEDRO DE URA", "MURINDO",
        "VIGIA DEL FUERTE",
    ],
}

# Fixed value: label for a municipality found in no list.
UNCLASSIFIED = "SIN CLASIFICAR"
