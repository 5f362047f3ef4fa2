"""Word lists, code tables, patterns and limits the results depend on.

They are defaults. Every operator takes them as arguments, so a caller can pass its own.
"""

# --- fixed values: words removed from business names ---------------------------------------------------------------
FRANCHISES = [
    "EUROTYRE", "SPEEDY", "NORAUTO", "MIDAS", "POINT S", "EUROMASTER", "FEU VERT", "SILIGOM", "EUROREPAR", "AUTOSUR",
    "AUTOVISION", "DEKRA", "SECURITEST", "MOTRIO", "AD EXPERT", "AD ", "ROADY", "FIRST STOP", "VULCO", "CARGLASS",
    "CARTER CASH", "OSCARO",
]
CAR_BRANDS = [
    "RENAULT", "PEUGEOT", "CITROEN", "CITROËN", "DACIA", "TOYOTA", "FORD", "FIAT", "BMW", "MERCEDES", "AUDI",
    "VOLKSWAGEN", "OPEL", "NISSAN", "HYUNDAI", "KIA", "HONDA", "SUZUKI", "VOLVO", "MAZDA", "SEAT", "SKODA",
    "MITSUBISHI", "JEEP", "SUBARU", "ISUZU", "IVECO",
]
LEGAL_FORMS = [
    "SARL", "SAS", "SASU", "SA", "EURL", "SCI", "EI", "SNC", "ETS", "ETABLISSEMENTS", "ETABLISSEMENT", "SOCIETE",
    "SOC", "GIE", "SELARL", "SELAS", "SCP", "SCOP", "ASSOCIATION", "ASSOC",
]
ARTICLES = [
    "ET", "FILS", "CIE", "CHEZ", "LE", "LA", "LES", "DU", "DES", "DE", "AU", "AUX", "A", "EN", "PAR", "POUR", "L",
]
GENERIC_WORDS = [
    "GARAGE", "AUTO", "AUTOMOBILE", "AUTOMOBILES", "CARROSSERIE", "MOTO", "MOTOS", "PNEUS", "PNEU", "SERVICE",
    "SERVICES", "MECANIQUE", "REPARATION", "REPARATIONS", "CONTROLE", "TECHNIQUE", "CENTRE", "ATELIER", "DEPANNAGE",
    "PIECES", "AUTOS", "CAR", "CARS",
]

# --- fixed values: street words ------------------------------------------------------------------------------------
STREET_SHORT = [
    ("RUE", "R"), ("AVENUE", "AV"), ("BOULEVARD", "BD"), ("IMPASSE", "IMP"), ("CHEMIN", "CH"), ("ROUTE", "RTE"),
    ("PLACE", "PL"), ("ALLEE", "ALL"),
]
STREET_ARTICLES = ["DU", "DE LA", "DE L", "DES", "DE", "D", "LE", "LA", "LES", "L"]

# --- fixed values: activity prefix -> funding body -----------------------------------------------------------------
ACTIVITY_FUNDING = {
    "01": "OCAPIAT", "02": "OCAPIAT", "03": "OCAPIAT", "10": "OCAPIAT", "11": "OCAPIAT", "75": "OCAPIAT",
    "24": "OPCO 2i", "25": "OPCO 2i", "26": "OPCO 2i", "27": "OPCO 2i", "28": "OPCO 2i", "29": "OPCO 2i",
    "30": "OPCO 2i", "33": "OPCO 2i", "41": "CONSTRUCTYS", "42": "CONSTRUCTYS", "43": "CONSTRUCTYS",
    "45": "OPCO Mobilités", "46": "OPCOMMERCE", "47": "OPCOMMERCE", "49": "OPCO Mobilités", "50": "OPCO Mobilités",
    "51": "OPCO Mobilités", "52": "OPCO Mobilités", "53": "OPCO Mobilités", "55": "AKTO", "56": "AKTO", "58": "AFDAS",
    "59": "AFDAS", "60": "AFDAS", "61": "AFDAS", "62": "ATLAS", "63": "ATLAS", "64": "ATLAS", "65": "ATLAS",
    "66": "ATLAS", "68": "OPCO EP", "69": "ATLAS", "70": "ATLAS", "71": "ATLAS", "73": "ATLAS", "74": "ATLAS",
    "78": "ATLAS", "81": "AKTO", "85": "AKTO", "86": "OPCO Santé", "87": "OPCO Santé", "88": "OPCO Santé",
    "90": "AFDAS", "91": "AFDAS", "92": "AFDAS", "93": "AFDAS", "96": "OPCO EP",
}
# Brands (lower case, first hit wins in this order) that all belong to one funding body.
BRAND_FUNDING_BODY = "OPCO Mobilités"
FUNDED_BRANDS = [
    "speedy", "norauto", "midas", "feu vert", "euromaster", "point s", "eurotyre", "siligom", "eurorepar", "autosur",
    "autovision", "dekra", "securitest", "motrio", "roady", "vulco", "first stop", "carglass", "renault", "peugeot",
    "citroen", "toyota", "ford", "bmw", "mercedes", "audi", "volkswagen",
]
UNKNOWN_FUNDING = "À déterminer"

# --- fixed values: headcount codes ---------------------------------------------------------------------------------
HEADCOUNT_RANGES = {
    "NN": "0", "00": "0", "01": "1-2", "02": "3-5", "03": "6-9", "11": "10-19", "12": "20-49", "21": "50-99",
    "22": "100-199", "31": "200-249", "32": "250-499", "41": "500-999", "42": "1000-1999", "51": "2000-4999",
    "52": "5000-9999", "53": "10000+",
}
SIZE_CLASSES = {
    "MOINS_11": ["NN", "00", "01", "02", "03"],
    "DE_11_A_49": ["11", "12"],
    "PLUS_DE_50": ["21", "22", "31", "32", "41", "42", "51", "52", "53"],
}
ALL_SIZES = "TOUTES"

# --- fixed values: regions -----------------------------------------------------------------------------------------
REGION_DEPARTMENTS = {
    "ILE_DE_FRANCE": ["75", "77", "78", "91", "92", "93", "94", "95"],
    "AUVERGNE_RHONE_ALPES": ["01", "03", "07", "15", "26", "38", "42", "43", "63", "69", "73", "74"],
    "BOURGOGNE_FRANCHE_COMTE": ["21", "25", "39", "58", "70", "71", "89", "90"],
    "BRETAGNE": ["22", "29", "35", "56"],
    "CENTRE_VAL_DE_LOIRE": ["18", "28", "36", "37", "41", "45"],
    "CORSE": ["2A", "2B"],
    "GRAND_EST": ["08", "10", "51", "52", "54", "55", "57", "67", "68", "88"],
    "HAUTS_DE_FRANCE": ["02", "59", "60", "62", "80"],
    "NORMANDIE": ["14", "27", "50", "61", "76"],
    "NOUVELLE_AQUITAINE": ["16", "17", "19", "23", "24", "33", "40", "47", "64", "79", "86", "87"],
    "OCCITANIE": ["09", "11", "12", "30", "31", "32", "34", "46", "48", "65", "66", "81", "82"],
    "PAYS_DE_LA_LOIRE": ["44", "49", "53", "72", "85"],
    "PROVENCE_ALPES_COTE_AZUR": ["04", "05", "06", "13", "83", "84"],
    "DOM": ["971", "972", "973", "974", "976"],
}
REGION_NAMES = {
    "ILE_DE_FRANCE": "Île-de-France", "AUVERGNE_RHONE_ALPES": "Auvergne-Rhône-Alpes",
    "BOURGOGNE_FRANCHE_COMTE": "Bourgogne-Franche-Comté", "BRETAGNE": "Bretagne",
    "CENTRE_VAL_DE_LOIRE": "Centre-Val de Loire", "CORSE": "Corse", "GRAND_EST": "Grand Est",
    "HAUTS_DE_FRANCE": "Hauts-de-France", "NORMANDIE": "Normandie", "NOUVELLE_AQUITAINE": "Nouvelle-Aquitaine",
    "OCCITANIE": "Occitanie", "PAYS_DE_LA_LOIRE": "Pays de la Loire",
    "PROVENCE_ALPES_COTE_AZUR": "Provence-Alpes-Côte d'Azur",
}
OVERSEAS_NAMES = {
    "971": "Guadeloupe", "972": "Martinique", "973": "Guyane", "974": "La Réunion", "976": "Mayotte",
}

# --- fixed values: neighbouring postcodes, in the order they are tried ---------------------------------------------
NEARBY_POSTCODES = {
    "200": ["20000", "20090", "20100", "20167", "20166", "20190"],
    "201": ["20100", "20200", "20137", "20169"],
}
NEARBY_DEPARTMENTS = ["2A", "2B", "97"]

# --- fixed values: identifiers in web pages ------------------------------------------------------------------------
LONG_ID_PATTERN = r"(?:SIRET|siret|Siret)\s*[:.\-]?\s*(\d{3}[\s.]?\d{3}[\s.]?\d{3}[\s.]?\d{5})"
SHORT_ID_PATTERN = r"(?:SIREN|siren|Siren)\s*[:.\-]?\s*(\d{3}[\s.]?\d{3}[\s.]?\d{3})"
BARE_ID_PATTERN = r"\b(\d{14})\b"
LEGAL_PATHS = [
    "/mentions-legales", "/mentions-legales/", "/mentions", "/legal", "/cgu", "/cgv", "/a-propos",
    "/qui-sommes-nous", "/about", "/contact", "/infos-legales",
]

# --- fixed values: method labels, sources, thresholds --------------------------------------------------------------
METHOD_NAME_EXACT = "API_RECHERCHE_EXACT"
METHOD_NAME_PROBABLE = "API_RECHERCHE_PROBABLE"
METHOD_ADDRESS_ONE = "ADDRESS_UNIQUE"
METHOD_ADDRESS_MANY = "ADDRESS_MULTI"
METHOD_TRIGRAM = "TRIGRAM_FUZZY"
METHOD_PAGE_KNOWN = "SCRAPE_MENTIONS_LEGALES"
METHOD_PAGE_UNKNOWN = "SCRAPE_NON_VALIDE"
METHOD_NONE = "NON_TROUVE"
METHOD_CLOSED = "RADIE"
SOURCE_ACTIVITY = "NAF"
SOURCE_BRAND = "ENSEIGNE"
SOURCE_OFFICIAL = "FRANCE_COMPETENCES"
STATUS_FOUND = "À contacter"
STATUS_MISSING = "Non enrichi"
TRIGRAM_THRESHOLD = 0.2
NAME_EXACT_AT = 65.0
NAME_PROBABLE_AT = 40.0
ADDRESS_AT = 50.0
TRIGRAM_AT = 45.0

# --- fixed values: input headers -----------------------------------------------------------------------------------
PROSPECT_HEADERS = {
    "nom": ["nom", "name", "raison_sociale", "entreprise"],
    "adresse": ["adresse", "address", "adresse_complete"],
    "code_postal": ["code_postal", "cp", "postal_code", "zip"],
    "ville": ["ville", "city", "commune"],
    "departement": ["departement", "dept", "department"],
    "telephone": ["telephone", "tel", "phone"],
    "site_web": ["site_web", "website", "url", "site"],
    "email": ["email", "mail", "e-mail"],
    "secteur_recherche": ["secteur_recherche", "secteur", "type", "category"],
    "place_id": ["place_id"],
    "rating": ["rating", "note"],
    "avis": ["avis", "reviews", "nb_avis"],
}
REGISTRY_HEADERS = {
    "siret": "siret",
    "siren": "siren",
    "denomination": "denominationUniteLegale",
    "denomination_usuelle": "denominationUsuelle1UniteLegale",
    "denomination_usuelle_etab": "denominationUsuelleEtablissement",
    "enseigne": "enseigne1Etablissement",
    "enseigne2": "enseigne2Etablissement",
    "naf": "activitePrincipaleEtablissement",
    "numero_voie": "numeroVoieEtablissement",
    "type_voie": "typeVoieEtablissement",
    "voie": "libelleVoieEtablissement",
    "code_postal": "codePostalEtablissement",
    "commune": "libelleCommuneEtablissement",
    "tranche_effectif": "trancheEffectifsEtablissement",
    "date_creation": "dateCreationEtablissement",
    "etat_administratif": "etatAdministratifEtablissement",
}
LEGAL_UNIT_HEADERS = {
    "siren": "siren",
    "denomination": "denominationUniteLegale",
    "denomination_usuelle": "denominationUsuelle1UniteLegale",
}
REGISTRY_COLUMNS = [
    "siret", "siren", "denomination", "denomination_usuelle", "enseigne", "enseigne2", "naf", "numero_voie",
    "type_voie", "voie", "code_postal", "commune", "tranche_effectif", "date_creation", "etat_administratif",
    "departement", "denomination_clean", "enseigne_clean", "voie_clean",
]
RESULT_TEXT_COLUMNS = [
    "siret", "siren", "denomination", "enseigne", "naf", "libelle_naf", "effectif", "tranche_effectif_code",
    "date_creation", "dirigeant", "code_postal", "commune", "numero_voie", "voie", "methode", "opco", "source_opco",
    "idcc", "convention_collective",
]
EXTRACT_COLUMNS = {
    "SIRET": "siret", "SIREN": "siren", "Dénomination": "denomination", "Enseigne": "enseigne", "Code NAF": "naf",
    "Code Postal": "code_postal", "Commune": "commune", "Département": "departement", "Adresse": "adresse",
    "Effectif": "tranche_effectif", "Date création": "date_creation", "OPCO": "opco", "IDCC": "idcc",
    "Convention Collective": "convention_collective", "Email": "email", "Téléphone": "telephone",
}
