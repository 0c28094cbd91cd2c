"""Word lists and rule tables that results depend on.

Each list is stated as it applies, in its order. Substring matching is the rule
wherever a list holds short words. Entries after an ``English`` mark serve tables
with English names and come after the Spanish ones, so they never win over them.
"""

# The first three synonyms of each business term, in order of the terms.
SYNONYMS = {
    "sucursal": ("almacén", "almacenes", "bodega"),
    "sucursales": ("almacén", "almacenes", "bodegas"),
    "tienda": ("almacén", "almacenes", "sucursal"),
    "tiendas": ("almacén", "almacenes", "sucursales"),
    "almacen": ("sucursal", "tienda", "bodega"),
    "almacenes": ("sucursales", "tiendas", "bodegas"),
    "bodega": ("almacén", "sucursal", "warehouse"),
    "bodegas": ("almacenes", "sucursales", "warehouses"),
    "punto de venta": ("almacén", "sucursal", "tienda"),
    "puntos de venta": ("almacenes", "sucursales", "tiendas"),
    "producto": ("artículo", "artículos", "item"),
    "productos": ("artículos", "artículo", "items"),
    "articulo": ("producto", "item", "mercancía"),
    "articulos": ("productos", "items", "mercancías"),
    "item": ("artículo", "producto", "mercancía"),
    "items": ("artículos", "productos", "mercancías"),
    "mercancia": ("producto", "artículo", "item"),
    "mercancias": ("productos", "artículos", "items"),
    "cliente": ("comprador", "consumidor", "cuenta"),
    "clientes": ("compradores", "consumidores", "cuentas"),
    "comprador": ("cliente", "consumidor"),
    "compradores": ("clientes", "consumidores"),
    "consumidor": ("cliente", "comprador"),
    "consumidores": ("clientes", "compradores"),
    "venta": ("factura", "ticket", "transacción"),
    "ventas": ("facturas", "tickets", "transacciones"),
    "factura": ("venta", "documento de venta", "invoice"),
    "facturas": ("ventas", "documentos de venta", "invoices"),
    "ticket": ("venta", "factura", "comprobante"),
    "tickets": ("ventas", "facturas", "comprobantes"),
    "vendedor": ("agente", "empleado", "asesor"),
    "vendedores": ("agentes", "empleados", "asesores"),
    "agente": ("vendedor", "empleado", "asesor"),
    "agentes": ("vendedores", "empleados", "asesores"),
    "asesor": ("vendedor", "agente", "empleado"),
    "asesores": ("vendedores", "agentes", "empleados"),
    "inventario": ("stock", "existencias", "existencia"),
    "stock": ("inventario", "existencias", "existencia"),
    "existencia": ("inventario", "stock", "disponibilidad"),
    "existencias": ("inventario", "stock", "disponibilidad"),
    "proveedor": ("vendor", "supplier", "abastecedor"),
    "proveedores": ("vendors", "suppliers", "abastecedores"),
    "precio": ("costo", "valor", "importe"),
    "precios": ("costos", "valores", "importes"),
    "costo": ("precio", "valor"),
    "costos": ("precios", "valores"),
}

# Words of a question by family, with the weight of one match.
COMPLEXITY_WORDS = {
    "high": (25, ("subconsulta", "subquery", "cte", "with", "window", "partition", "over",
                  "row_number", "rank", "dense_rank", "lag", "lead", "union", "intersect",
                  "except", "recursive", "pivot", "unpivot")),
    "medium": (10, ("join", "inner", "left", "right", "full", "cross", "group by", "having",
                    "distinct", "case when", "coalesce", "cast")),
    "aggregation": (8, ("sum", "count", "avg", "max", "min", "total", "promedio", "suma", "conteo",
                        "cantidad", "maximo", "máximo", "minimo", "mínimo")),
    "multi_table": (5, ("y", "con", "de", "desde", "relacionado", "combinado", "cruzado", "junto",
                        "vinculado", "asociado", "entre")),
    "temporal": (7, ("mes", "año", "trimestre", "periodo", "fecha", "tiempo", "día", "semana",
                     "histórico", "tendencia", "crecimiento", "evolución")),
    "financial": (12, ("margen", "utilidad", "ganancia", "rentabilidad", "ratio", "porcentaje",
                       "proporción", "comparativo", "diferencia", "variación")),
}
MULTI_ANALYSIS = ("y también", "además", "igualmente", "comparar con", "diferencia entre",
                  "relación entre", "versus")
HEAVY_TABLES = ("DOCTOS_PV_DET", "DOCTOS_CC_DET", "MOVIMIENTOS_ALMACEN", "EXISTENCIAS",
                "PRECIOS_ARTICULOS", "CLAVES_ARTICULOS", "MOVIMIENTOS_CAJA")

# Words that mark a question about data. The default is the asking
# verbs, question words and words of time below, with every term of the synonym
# table and of the counting, time and money families; a longer list is a parameter.
ASKING_WORDS = (
    "dame", "dime", "muestra", "muéstrame", "enseña", "consulta", "busca", "encuentra", "obten",
    "obtén", "lista", "ver", "visualiza", "mostrar", "trae", "saca", "necesito", "quiero",
    "selecciona", "filtrar", "recupera", "consigue", "presenta", "exhibir",
    "cuanto", "cuánto", "cuanta", "cuánta", "cuando", "cuándo", "cual", "cuál", "que", "qué",
    "quien", "quién", "donde", "dónde", "como", "cómo",
    "hay", "existe", "tengo", "tiene", "tenemos", "incluye", "dispone", "disponible", "esta", "está",
    "hoy", "ayer", "mañana", "actual", "ahora", "reciente", "pasado",
)


def intent_words() -> tuple[str, ...]:
    """The default words of a data question, without those another one covers."""
    words = list(ASKING_WORDS) + list(SYNONYMS)
    for family in ("aggregation", "temporal", "financial"):
        words += COMPLEXITY_WORDS[family][1]
    words = list(dict.fromkeys(words))
    return tuple(w for w in words if not any(o != w and o in w for o in words))


# Lines of an answer that name SQL.
SQL_LINE_WORDS = ("consulta sql", "sql generado", "sql query", "select ", "from ", "where ")

# Forbidden patterns of a statement, over its upper-case text.
FORBIDDEN_SQL = (
    ("statement", r"\b(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE|TRUNCATE|EXEC)\b"),
    ("procedure", r"\b(XP_|SP_)\w+"),
    ("line comment", r"--"),
    ("block comment", r"/\*.*?\*/"),
    ("nested select", r"\b(UNION|EXCEPT|INTERSECT)\b.*\b(SELECT)\b"),
)

# Names of tables out of use, of catalogs, of master tables.
INACTIVE_PREFIXES = ("OLD_", "BAK_", "TMP_", "TEMP_", "TEST_", "DEL_", "LOG_")
INACTIVE_SUFFIXES = ("_OLD", "_BAK", "_TMP", "_TEMP", "_TEST", "_DEL", "_LOG")
CATALOG_WORDS = ("CATALOGO", "CATALOG", "CODIGO", "CODIGOS", "TIPO", "TIPOS", "ARTICULOS",
                 "CLIENTES", "PROVEEDORES")
MASTER_WORDS = ("MAESTRO", "MASTER", "CABECERA", "HEADER", "PRINCIPAL")

# Category of a table by words in its name, first match wins.
CATEGORIES = (
    ("VENTAS", ("venta", "ticket", "pos", "factura", "doctos_pv", "doctos_ve")),
    ("COMPRAS", ("compra", "orden_compra", "doctos_in", "requisicion")),
    ("CLIENTES", ("cliente", "customer", "consumidor")),
    ("PROVEEDORES", ("proveedor", "vendor", "supplier")),
    ("INVENTARIO", ("articulo", "producto", "item", "existencia", "inventario", "almacen")),
    ("RECURSOS_HUMANOS", ("empleado", "personal", "trabajador", "usuario")),
    ("FINANZAS", ("pago", "cobranza", "abono", "saldo", "cuenta", "banco")),
    ("OPERACIONES", ("pedido", "cotizacion", "orden", "remision")),
    ("AUDITORIA", ("reporte", "log", "auditoria", "bitacora", "historial")),
    ("CATALOGOS", ("config", "parametro", "catalogo", "tipo", "categoria", "grupo")),
    # English
    ("OPERACIONES", ("order",)),
    ("INVENTARIO", ("part",)),
)

# Meaning of a column by words in its name.
FIELD_MEANINGS = {
    "identificación": ("id", "codigo", "code", "clave", "key", "folio", "numero"),
    "nombres y descripciones": ("nombre", "name", "descripcion", "desc", "titulo", "title"),
    "fechas y tiempos": ("fecha", "date", "time", "hora", "timestamp", "created", "updated", "modified"),
    "importes y precios": ("precio", "price", "monto", "amount", "importe", "costo", "cost", "total", "subtotal"),
    "cantidades": ("cantidad", "qty", "quantity", "stock", "existencia", "unidades"),
    "estados": ("status", "estado", "activo", "active", "vigente", "eliminado", "deleted"),
    "personas": ("cliente", "customer", "proveedor", "vendor", "empleado", "employee", "usuario", "user"),
    "ubicaciones": ("direccion", "address", "ciudad", "city", "pais", "country", "zona", "region", "almacen", "warehouse"),
    "contacto": ("email", "mail", "telefono", "phone", "celular", "mobile", "contacto", "contact"),
    "financiero": ("pago", "payment", "saldo", "balance", "credito", "credit", "deuda", "debt"),
    "impuestos": ("iva", "tax", "impuesto", "ieps", "retencion"),
    "documentos": ("factura", "invoice", "pedido", "order", "nota", "recibo", "receipt", "documento", "document"),
}

# Parts of the semantic summary: label, words in the column name, most names.
SUMMARY_PARTS = (
    ("Identificadores", ("_id", "codigo", "cve_", "clave"), 5),
    ("Valores monetarios", ("precio", "importe", "costo", "monto", "total", "subtotal"), 5),
    ("Cantidades", ("cantidad", "unidades", "qty", "existencia", "stock"), 3),
    ("Fechas", ("fecha", "date", "timestamp", "hora"), 3),
    ("Personas/Entidades", ("cliente", "proveedor", "empleado", "vendedor", "usuario"), 3),
    ("Descripciones", ("nombre", "descripcion", "name", "desc"), 3),
)
# English
SUMMARY_ENGLISH = {
    "Identificadores": ("key",), "Valores monetarios": ("price", "discount", "tax", "acctbal"),
    "Cantidades": ("quantity", "size"), "Fechas": (), "Personas/Entidades": ("cust", "supp", "user"),
    "Descripciones": ("text",),
}

# Purpose of a table. Words in the table name; its sentence; then
# sentences that are added when words occur in the column names or the table name.
# ``needs`` lists column words without which the family says nothing.
PURPOSES = (
    {"name": ("venta", "factura", "ticket", "pos", "doctos_pv", "doctos_ve"),
     "needs": ("importe", "precio", "unidades", "cantidad"),
     "says": "Registra transacciones de venta",
     "detail": ("det",),
     "detail_says": "Detalle de productos vendidos en cada operación",
     "header_says": "Encabezado de documentos de venta con cliente, fecha y totales"},
    {"name": ("cliente", "customer"), "says": "Información de clientes y compradores",
     "columns": ((("direccion", "domicilio"), "Incluye datos de contacto y ubicación"),)},
    {"name": ("articulo", "producto", "item"),
     "says": "Catálogo de productos y artículos comercializados",
     "columns": ((("precio",), "Contiene precios y características de venta"),
                 (("existencia", "stock"), "Incluye información de inventario disponible"))},
    {"name": ("existencia", "inventario", "stock"),
     "says": "Control de inventario y cantidades disponibles por almacén",
     "table": ((("movimiento", "movto"), "Registra movimientos de entrada y salida de mercancía"),)},
    {"name": ("compra", "purchase", "orden_compra"), "says": "Gestión de compras y adquisiciones",
     "columns": ((("proveedor",), "Relaciona órdenes con proveedores"),)},
    {"name": ("proveedor", "vendor", "supplier"), "says": "Información de proveedores y vendedores"},
    {"name": ("empleado", "employee", "personal", "vendedor"),
     "says": "Datos de empleados y personal de la empresa"},
    {"name": ("pago", "cobranza", "abono"), "says": "Gestión de pagos y cobranzas",
     "columns": ((("saldo",), "Incluye seguimiento de saldos y deudas"),)},
    {"name": ("categoria", "grupo", "familia", "linea", "marca", "tipo"),
     "says": "Catálogo de clasificación y agrupación"},
    {"name": ("config", "parametro", "param"), "says": "Configuración y parámetros del sistema"},
)
PURPOSE_TRANSACTIONS = "Registros transaccionales con fechas y valores monetarios"
PURPOSE_CATALOG = "Catálogo o maestro de datos"

# Search terms by words in the table name (at most eight each), terms
# of every table, and terms by words in the column names.
SEARCH_TERMS = {
    "venta": ("vender", "vendido", "transacción", "ingreso", "ticket", "factura", "cobro"),
    "cliente": ("comprador", "consumidor", "usuario final", "socio comercial"),
    "articulo": ("producto", "mercancía", "ítem", "SKU", "inventario", "activo", "activos", "disponible"),
    "proveedor": ("vendor", "supplier", "abastecedor", "distribuidor"),
    "inventario": ("existencia", "stock", "almacén", "bodega", "disponible"),
    "compra": ("adquisición", "orden de compra", "procurement", "abastecimiento"),
    "precio": ("costo", "importe", "valor", "monto", "tarifa"),
    "pago": ("abono", "cobranza", "liquidación", "transacción financiera"),
    "empleado": ("trabajador", "personal", "colaborador", "staff"),
    "pedido": ("orden", "solicitud", "requerimiento", "order"),
    "factura": ("invoice", "comprobante", "documento fiscal"),
    # English
    "customer": ("cliente", "clientes", "comprador", "customer"),
    "supplier": ("proveedor", "proveedores", "supplier"),
    "part": ("producto", "articulo", "part"),
    "order": ("pedido", "venta", "ventas", "order"),
}
GENERAL_TERMS = ("cuántos", "cuantos", "cantidad de", "total de", "contar", "listar", "mostrar",
                 "registros", "elementos")
COLUMN_TERMS = (
    (("estatus", "status", "activo", "active"),
     ("activo", "activos", "vigente", "vigentes", "disponible", "disponibles", "inactivo", "inactivos")),
    (("fecha", "date"), ("temporal", "histórico", "cronológico")),
    (("importe", "precio", "monto"), ("financiero", "monetario", "económico")),
    (("cantidad", "unidades"), ("volumen", "conteo", "suma", "total")),
)
NAME_TERMS = (
    (("det",), ("línea", "ítem", "movimiento individual", "partida")),
    (("encab", "header", "docto"), ("documento", "cabecera", "resumen")),
)

# Words of the sample patterns.
SEQUENCE_WORDS = ("id", "folio", "numero", "key")
NAME_WORDS = ("nombre", "descripcion", "name")
MONEY_WORDS = ("precio", "importe", "total", "costo", "monto", "price", "amount")
AUDIT_WORDS = ("creado", "modificado", "usuario", "created", "updated")

# Importance of a neighbour in the stored relation graph.
NEIGHBOUR_WORDS = (
    (10, ("codigo", "clave", "detalle", "det", "linea")),
    (7, ("tipo", "grupo", "categoria", "familia")),
    (9, ("existencia", "precio", "costo")),
)
NEIGHBOUR_BASE = 8

# The stored procedures known by name.
PROCEDURES = (
    ("SP_EXISTENCIAS_ARTICULO", "Obtener existencias actuales de artículos por almacén",
     ("Control de inventario", "Consulta de existencias"), 15),
    ("SP_VENTAS_PERIODO", "Análisis de ventas por período",
     ("Análisis de ventas", "Generación de reportes"), 25),
    ("SP_COSTO_PROMEDIO", "Cálculo de costo promedio de artículos",
     ("Cálculo de costos", "Análisis financiero"), 20),
)
