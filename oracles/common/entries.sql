select * from (values
 ('AGPL-3.0-only','network-copyleft',1,'HIGH'),
 ('Apache-2.0','permissive',5,'HIGH'),
 ('BSD-3-Clause','permissive',5,'HIGH'),
 ('CC-BY-NC-4.0','non-commercial',1,'HIGH'),
 ('Elastic-2.0','source-available',1,'MEDIUM'),
 ('GPL-3.0-only','strong-copyleft',1,'HIGH'),
 ('ISC','permissive',5,'HIGH'),
 ('LGPL-3.0-only','weak-copyleft',2,'HIGH'),
 ('Llama-3.1-Community','custom',3,'MEDIUM'),
 ('MIT','permissive',5,'HIGH'),
 ('MPL-2.0','weak-copyleft',3,'HIGH'),
 ('SSPL-1.0','source-available',1,'MEDIUM')
) t(entry_spdx, entry_family, entry_permissiveness, entry_confidence)
