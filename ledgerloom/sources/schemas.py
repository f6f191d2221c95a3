"""Declared table schemas and enum domains (the ledger's data model)."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum domains of the ledger.
ORDER_STATUSES = ["draft", "confirmed", "in_production", "ready_to_ship", "shipped", "completed", "cancelled"]
SHIPMENT_STATUSES = ["draft", "ready_to_ship", "shipped", "completed", "cancelled"]
PARTY_TYPES = ["client", "customs_consignee", "notify_party", "clearing_agent"]
PACKAGE_TYPES = ["Jar", "Pouch", "Box"]
DOCUMENT_ACTIONS = ["previewed", "printed", "downloaded"]
ORDER_DOCUMENT_TYPES = [
    "sale_contract", "customs_packing_list", "customs_commercial_invoice", "client_packing_list",
    "client_commercial_invoice", "gate_pass", "bl_instructions", "certificate_of_origin",
]
SHIPMENT_DOCUMENT_TYPES = ORDER_DOCUMENT_TYPES[1:]

_TS = "created_at timestamp, updated_at timestamp"

# Stored columns and their types.
_DDL = {
    "company_settings": "id tinyint, company_name string, tagline string, address string, phone string, email string, "
                        "website string, bank_details string, default_sale_terms string, invoice_prefix string, "
                        "updated_at timestamp",
    "permissions": "id bigint, permission_key string, module_name string, action_name string, description string",
    "roles": f"id bigint, name string, description string, is_system boolean, {_TS}",
    "role_permissions": "role_id bigint, permission_id bigint",
    "users": f"id bigint, role_id bigint, name string, email string, phone string, is_active boolean, "
             f"last_login_at timestamp, {_TS}",
    "parties": "id bigint, party_type string, name string, contact_person string, business_id string, "
               "phone string, email string, address_line_1 string, address_line_2 string, city string, "
               f"state_region string, country string, postal_code string, is_active boolean, {_TS}",
    "products": "id bigint, sku string, name string, description string, hs_code string, package_type string, "
                "units_per_carton decimal(12,3), pieces_per_unit decimal(12,3), unit_weight_grams decimal(12,3), "
                "net_weight_per_carton decimal(12,3), gross_weight_per_carton decimal(12,3), "
                "packaging_details string, default_client_price decimal(14,4), "
                f"default_customs_price_per_kg decimal(14,4), image_url string, is_active boolean, {_TS}",
    "bank_accounts": "id bigint, account_name string, beneficiary_name string, bank_name string, branch_name string, "
                     "account_number string, iban string, swift_code string, currency string, "
                     "correspondent_bank string, correspondent_account string, correspondent_swift_code string, "
                     f"instructions string, is_active boolean, {_TS}",
    "export_orders": "id bigint, invoice_number string, sequence_number int, sequence_year int, client_id bigint, "
                     "customs_consignee_id bigint, bank_account_id bigint, created_by bigint, status string, "
                     "contract_date date, valid_until date, sales_contract_number string, payment_term string, "
                     "advance_percentage decimal(5,2), freight_amount decimal(14,2), currency string, "
                     "port_of_loading string, port_of_destination string, final_destination string, "
                     "shipping_type string, shipped_per string, vessel_name string, voyage_number string, bl_number string, "
                     "bl_date date, container_number string, container_type string, cbm decimal(12,3), "
                     "freight_term string, truck_number string, driver_name string, driver_phone string, "
                     "clearing_agent_id bigint, transporter_name string, transporter_contact string, "
                     "transporter_phone string, loading_address string, delivery_address string, "
                     "seal_numbers string, customer_instructions string, shipping_instructions string, notes string, "
                     f"confirmed_at timestamp, {_TS}",
    "export_order_items": "id bigint, export_order_id bigint, product_id bigint, line_number int, carton_start int, "
                          "carton_end int, quantity decimal(12,3), quantity_unit string, units_per_carton decimal(12,3), "
                          "net_weight_per_carton decimal(12,3), gross_weight_per_carton decimal(12,3), "
                          "client_price_per_carton decimal(14,4), customs_price_per_kg decimal(14,4), "
                          f"is_sample boolean, description_override string, {_TS}",
    "shipments": "id bigint, shipment_number string, sequence_number int, sequence_year int, client_id bigint, "
                 "customs_consignee_id bigint, also_notify_party_id bigint, created_by bigint, status string, "
                 "shipment_date date, gd_number string, fi_number string, currency string, port_of_loading string, "
                 "port_of_destination string, final_destination string, "
                 "shipping_type string, shipped_per string, vessel_name string, voyage_number string, bl_number string, "
                 "bl_date date, container_number string, container_type string, cbm decimal(12,3), "
                 "freight_term string, truck_number string, driver_name string, driver_phone string, "
                 "clearing_agent_id bigint, transporter_name string, transporter_contact string, "
                 "transporter_phone string, loading_address string, delivery_address string, "
                 "seal_numbers string, shipping_instructions string, notes string, "
                 f"{_TS}",
    "shipment_containers": "id bigint, shipment_id bigint, line_number int, container_number string, "
                           f"container_type string, cbm decimal(12,3), seal_numbers string, {_TS}",
    "shipment_allocations": "id bigint, shipment_id bigint, shipment_container_id bigint, "
                            "export_order_item_id bigint, line_number int, quantity decimal(12,3), created_at timestamp",
    "order_payments": "id bigint, export_order_id bigint, amount decimal(14,2), payment_date date, "
                      "reference_number string, notes string, created_by bigint, created_at timestamp",
    "document_audit_logs": "id bigint, export_order_id bigint, user_id bigint, document_type string, "
                           "action_name string, created_at timestamp",
    "shipment_document_audit_logs": "id bigint, shipment_id bigint, user_id bigint, document_type string, "
                                    "action_name string, created_at timestamp",
}

class _LazySchemas(dict):
    """DDL strings parsed on first use (parsing needs an active Spark session)."""

    def __missing__(self, name: str) -> T.StructType:
        parsed = T._parse_datatype_string(_DDL[name])
        self[name] = parsed
        return parsed

    def __contains__(self, name) -> bool:
        return name in _DDL

    def __iter__(self):
        return iter(_DDL)


SCHEMAS: dict[str, T.StructType] = _LazySchemas()

PACKAGING_SCHEMA = "struct<pieces_per_pack: decimal(12,3), packs_per_carton: decimal(12,3)>"
