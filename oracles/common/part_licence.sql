-- expected resolution of every raw spelling, worked out by hand
select * from (values
 ('Brand#1','MIT','MIT',false,true,'high'),
 ('Brand#2','MIT License','MIT',false,true,'high'),
 ('Brand#3','Apache 2.0','Apache-2.0',false,true,'high'),
 ('Brand#4','apache-2.0','Apache-2.0',false,true,'high'),
 ('Brand#5','BSD','BSD-3-Clause',false,true,'high'),
 ('Brand#6','ISC','ISC',false,true,'high'),
 ('Brand#7','MPL 2.0','MPL-2.0',false,true,'high'),
 ('Brand#8','LGPLv3','LGPL-3.0-only',false,true,'high'),
 ('Brand#9','GPLv3','GPL-3.0-only',false,true,'high'),
 ('Brand#10','GPL-3.0+','',false,false,'low'),
 ('Brand#11','AGPL-3.0','AGPL-3.0-only',false,true,'high'),
 ('Brand#12','SSPL-1.0','SSPL-1.0',false,true,'high'),
 ('Brand#13','Elastic-2.0','Elastic-2.0',false,true,'high'),
 ('Brand#14','CC BY-NC 4.0','CC-BY-NC-4.0',false,true,'high'),
 ('Brand#15','Llama-3.1-Community','Llama-3.1-Community',false,true,'high'),
 ('Brand#16','BUSL-1.1','BUSL-1.1',false,true,'high'),
 ('Brand#17','MIT OR Apache-2.0','MIT OR Apache-2.0',true,true,'medium'),
 ('Brand#18','see LICENSE','',false,false,'low'),
 ('Brand#19','','',false,false,''),
 ('Brand#20','CC0','CC0-1.0',false,true,'high'),
 ('Brand#21','mit','MIT',false,true,'high'),
 ('Brand#22','(GPL-2.0-only WITH Classpath-exception-2.0)','(GPL-2.0-only WITH Classpath-exception-2.0)',true,true,'medium'),
 ('Brand#23','LicenseRef-Custom','LicenseRef-Custom',false,true,'high'),
 ('Brand#24','Foo OR Bar','',false,false,'low'),
 ('Brand#25','MPL-2.0+','MPL-2.0+',false,true,'high')
) t(brand, raw, spdx, expression, resolved, licence_confidence)
