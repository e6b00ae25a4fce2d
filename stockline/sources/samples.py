"""Sample rows for empty tables, in column order without id. No passwords: access is not part of this package."""

from __future__ import annotations

from datetime import date

# The sample set.
USERS = [
    ("admin", "Administrator", "admin", "081234567890"),
    ("kasir", "Kasir Toko", "kasir", "081234567891"),
    ("gudang", "Petugas Gudang", "gudang", "081234567892"),
]

CATEGORIES = [
    ("Elektronik", "Perangkat elektronik dan aksesoris"),
    ("Fashion", "Pakaian dan aksesori mode"),
    ("Makanan", "Bahan makanan dan snack"),
    ("Minuman", "Minuman kemasan dan segar"),
    ("Rumah Tangga", "Peralatan rumah tangga dan kebutuhan sehari-hari"),
    ("Perawatan", "Produk kebersihan dan perawatan diri"),
]

SUPPLIERS = [
    ("PT Elektronik Maju", "Jl. Merdeka No. 12", "081100112233", "supplier1@example.com"),
    ("CV Tekstil Sejahtera", "Jl. Kebon Jeruk No. 45", "081199887766", "supplier2@example.com"),
    ("PT Distributor Makanan", "Jl. Gatot Subroto No. 88", "082111223344", "supplier3@example.com"),
    ("CV Minuman Segar", "Jl. Ahmad Yani No. 30", "082244556677", "supplier4@example.com"),
    ("PT Perawatan Kecantikan", "Jl. Sudirman No. 99", "081333445566", "supplier5@example.com"),
]

PRODUCTS = [
    ("EL-001", "Smartphone Android 128GB", 1, "Unit", 2500000, 3500000, 15, date(2026, 5, 5), "Rak A1", 1),
    ("EL-002", "Powerbank 20000mAh", 1, "Unit", 150000, 250000, 32, date(2026, 5, 5), "Rak A2", 1),
    ("EL-003", "Charger USB-C 65W", 1, "Unit", 80000, 149000, 28, date(2026, 5, 5), "Rak A3", 1),
    ("EL-004", "Headphone Wireless", 1, "Unit", 200000, 399000, 18, date(2026, 5, 5), "Rak A4", 1),
    ("EL-005", "Kabel Data USB-C 2m", 1, "Unit", 25000, 49000, 50, date(2026, 5, 5), "Rak A5", 1),
    ("EL-006", "Tas Laptop 15 inch", 1, "Unit", 120000, 249000, 12, date(2026, 5, 5), "Rak A6", 1),
    ("FH-001", "T-Shirt Premium Cotton", 2, "Unit", 45000, 99000, 45, date(2026, 5, 6), "Rak B1", 2),
    ("FH-002", "Jeans Standar Blue", 2, "Unit", 120000, 249000, 30, date(2026, 5, 6), "Rak B2", 2),
    ("FH-003", "Kemeja Formal White", 2, "Unit", 80000, 179000, 25, date(2026, 5, 6), "Rak B3", 2),
    ("FH-004", "Jaket Casual Bomber", 2, "Unit", 150000, 349000, 16, date(2026, 5, 6), "Rak B4", 2),
    ("FH-005", "Sepatu Olahraga Putih", 2, "Pasang", 180000, 399000, 20, date(2026, 5, 6), "Rak B5", 2),
    ("FH-006", "Kaos Oblong Polos", 2, "Unit", 25000, 59000, 60, date(2026, 5, 6), "Rak B6", 2),
    ("MK-001", "Kopi Sachet Premium", 3, "Box (12 sachet)", 18000, 35000, 48, date(2026, 5, 7), "Rak C1", 3),
    ("MK-002", "Beras Premium 5kg", 3, "Karung", 60000, 89000, 25, date(2026, 5, 7), "Gudang 1", 3),
    ("MK-003", "Mie Instan Goreng", 3, "Dus (30 bungkus)", 24000, 45000, 35, date(2026, 5, 7), "Rak C2", 3),
    ("MK-004", "Snack Keripik Singkong", 3, "Kemasan 200g", 15000, 29000, 55, date(2026, 5, 7), "Rak C3", 3),
    ("MK-005", "Roti Tawar Putih", 3, "Bungkus", 18000, 35000, 40, date(2026, 5, 7), "Rak C4", 3),
    ("MK-006", "Telur Ayam 1 Lusin", 3, "Lusin", 20000, 38000, 50, date(2026, 5, 7), "Gudang 2", 3),
    ("MN-001", "Air Mineral 1.5L", 4, "Botol", 3000, 7000, 120, date(2026, 5, 8), "Rak D1", 4),
    ("MN-002", "Teh Manis Kemasan", 4, "Botol 500ml", 4500, 9000, 95, date(2026, 5, 8), "Rak D2", 4),
    ("MN-003", "Kopi Siap Minum", 4, "Kaleng 250ml", 8000, 15000, 72, date(2026, 5, 8), "Rak D3", 4),
    ("MN-004", "Jus Jeruk Natural", 4, "Botol 1L", 15000, 28000, 36, date(2026, 5, 8), "Rak D4", 4),
    ("MN-005", "Susu Cair Murni", 4, "Sachet 200ml", 5000, 10000, 80, date(2026, 5, 8), "Rak D5", 4),
    ("RT-001", "Sabun Cuci Piring", 5, "Botol 750ml", 8000, 14000, 45, date(2026, 5, 9), "Rak E1", 5),
    ("RT-002", "Deterjen Cair", 5, "Botol 1L", 15000, 27000, 30, date(2026, 5, 9), "Rak E2", 5),
    ("RT-003", "Sapu Plastik", 5, "Unit", 12000, 25000, 20, date(2026, 5, 9), "Rak E3", 5),
    ("RT-004", "Pengharum Ruangan", 5, "Botol 250ml", 18000, 35000, 28, date(2026, 5, 9), "Rak E4", 5),
    ("RT-005", "Tissue Gulung 4 Rol", 5, "Paket", 25000, 45000, 35, date(2026, 5, 9), "Rak E5", 5),
    ("PR-001", "Shampo Herbal 200ml", 6, "Botol", 25000, 49000, 32, date(2026, 5, 10), "Rak F1", 5),
    ("PR-002", "Sabun Mandi Cair", 6, "Botol 250ml", 12000, 24000, 48, date(2026, 5, 10), "Rak F2", 5),
    ("PR-003", "Pasta Gigi Peppermint", 6, "Tube 100g", 8000, 16000, 65, date(2026, 5, 10), "Rak F3", 5),
    ("PR-004", "Sikat Gigi Soft", 6, "Unit", 5000, 12000, 55, date(2026, 5, 10), "Rak F4", 5),
    ("PR-005", "Face Cream Moisturizer", 6, "Jar 50ml", 35000, 74000, 20, date(2026, 5, 10), "Rak F5", 5),
    ("PR-006", "Deodorant Stick 40g", 6, "Unit", 22000, 45000, 25, date(2026, 5, 10), "Rak F6", 5),
]
