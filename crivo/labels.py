"""Fixed report texts.

Every report of this library carries a verdict that people and downstream
checks compare literally, so the texts below are part of the data contract.
"""

# --- fixed values: must equal the texts users already compare against ---
KEY_UNIQUE = "CHAVE UNICA"
KEY_NOT_UNIQUE = "NAO UNICA - ha dimensao adicional"
KEY_NOT_UNIQUE_SHORT = "nao unica"
KEY_NONE = "NENHUMA - investigar"

FILL_ALL_NULL = "1. 100% NULO"
FILL_NO_USEFUL = "2. SEM VALOR UTIL"
FILL_ALMOST_EMPTY = "3. QUASE VAZIO (<1%)"
FILL_OK = "9. ok"

FILL3_NO_ROWS = "SEM LINHAS"
FILL3_ALL_NULL = "100% NULO - CONFERIR COMENTARIO"
FILL3_NO_USEFUL = "100% SEM VALOR UTIL - CONFERIR"
FILL3_OK = "COM DADOS"

CARD_CONSTANT = "1. CONSTANTE (1 valor)"
CARD_VERY_LOW = "2. cardinalidade muito baixa"
CARD_IDENTIFIER = "3. candidata a identificador"
CARD_NORMAL = "9. normal"

CARD3_CONSTANT = "CONSTANTE OU VAZIO"
CARD3_LOW = "BAIXA CARDINALIDADE"
CARD3_IDENTIFIER = "CANDIDATO A IDENTIFICADOR"
CARD3_NORMAL = "INTERMEDIARIA"

SCENARIO_CANDIDATE = "CANDIDATO A CENARIO DE TESTE"

VARIES = "VARIA - faz parte da chave real"
CONSTANT = "constante"

ROWS_DISTINCT = "OK - nenhuma linha totalmente identica"
ROWS_IDENTICAL = "ATENCAO - existem linhas identicas em todos os campos"

DATE_MIXED = "ALERTA: mais de um formato na mesma coluna"
DATE_SINGLE = "formato unico"
DATE_CLASS_BLANK = "VAZIA"
DATE_CLASS_OTHER = "OUTRO"

ALERT_LEADING_ZEROS = "tem zeros a esquerda"
ALERT_VARIABLE_LENGTH = "comprimento variavel"
ALERT_SPACES = "tem espacos"
ALERT_COLLISION = "COLISAO ao remover zeros"
ALERT_NUMERIC_TYPE = "TIPO NUMERICO - zeros a esquerda JA perdidos"

SNAPSHOT = "SNAPSHOT - substitui a cada carga; chave NAO precisa da data"
HISTORY = "HISTORICO - acumula; a chave DEVE incluir {}"

EQUATION_OK = "OK - equacao fecha"
EQUATION_ERROR = "ERRO - investigar"

REDUNDANT = "REDUNDANCIA CONFIRMADA"
NOT_REDUNDANT = "colunas divergem"

DECLARED_ALL_NULL = "CONFIRMADO - 100% nula"
DECLARED_ALL_BLANK = "CONFIRMADO - apenas vazio ou 0"
DECLARED_DIVERGES = "DIVERGE - ha valores"

DOMAIN_DECLARED = "dominio declarado"
DOMAIN_OUTSIDE = "FORA DO DOMINIO"

DESCRIPTION_ERROR = "ERRO - codigo com mais de uma descricao"
DERIVED_DIVERGES = "DIVERGENTE DA REGRA"
OK = "ok"

REPLICATED = "REPLICACAO CONFIRMADA"
NOT_REPLICATED = "ha variacao entre itens"

PRECISION_OVERSIZED = "{} superdimensionado - {} casas bastariam"
PRECISION_USED = "as casas extras tem uso real"

COLLAPSE_YES = "CHAVE REAL inclui {}"

CHALLENGE_FOUND = "ENCONTRADA_NA_COMPARACAO_DIRETA"
CHALLENGE_ABSENT = "AUSENTE_MESMO_NA_COMPARACAO_DIRETA"

BUCKET_BLANK = "(vazio)"
UNCLASSIFIED = "sem classificacao"
# --- end of fixed values ---

COLLAPSE_NO = "chave pai suficiente"
DEPENDENCY_HOLDS = "DETERMINA"
DEPENDENCY_FAILS = "nao determina"
REFERS = "REFERENCIA COMPLETA"
REFERS_NOT = "ha orfaos"
